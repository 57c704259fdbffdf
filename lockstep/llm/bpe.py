"""Byte-level BPE through sentencepiece: a model serialised from a rank file, encoding and decoding."""

from __future__ import annotations

import base64
import struct
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import text_or_empty
from lockstep.llm.pretokens import CachedEncoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Byte b stands for this code point plus b: 256 characters of which none is white space or a mark of sentencepiece.
FIRST_CHARACTER = 0x100
_CHARACTERS = {i: chr(FIRST_CHARACTER + i) for i in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def to_characters(raw: bytes) -> str:
    """Bytes as text, one mapped character for each."""
    return raw.decode("latin-1").translate(_CHARACTERS)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks.

    Pieces are the byte-mapped tokens scored by negative rank, so the merge of lowest
    rank goes first as in the rank file. The normaliser is the identity. The unknown
    piece, which the format wants, comes last; mapped bytes never reach it as long as the
    vocabulary holds all single bytes. Ranks must run from 0 without gaps and be exact as
    32-bit floats.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or len(tokens) >= 1 << 24:
        raise ValueError("ranks must run from 0 without gaps, below 2^24")
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("the vocabulary must hold every single byte")

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece(to_characters(t), -float(rank), normal) for rank, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, unknown))
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens))
    trainer += b"".join(_number(field, -1) for field in (41, 42, 43))  # no begin, end or padding piece
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class Codec:
    """Encodes and decodes by one vocabulary file. Its output is what tiktoken gives for the same ranks."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.encoder = CachedEncoder(pattern, self._encode_pieces, limit=4_000_000)

    @cached_property
    def model(self):
        """Built when first used: a worker that only decodes does without."""
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        raw = [x.encode() for x in pieces]
        merged = self.model.encode([to_characters(x) for x in raw], out_type=int, num_threads=1)
        # a piece that is a token is that token, also if no order of merges leads to it
        return [[self.ranks[x]] if x in self.ranks else ids for x, ids in zip(raw, merged)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; none for null."""
        return self.encoder.encode(text)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that the ids stand for; an id outside the vocabulary is an error."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    return Codec(path, pattern)


def encode(text: Column, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The ids of a text, as little-endian unsigned 32-bit numbers in a binary. Null and empty texts have none.

    ``path`` must be readable on every executor.
    """

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([codec(path, pattern).encode(t) for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes behind ids as :func:`encode` gives them. Null is empty."""

    @F.pandas_udf("binary")
    def raw(column: pd.Series) -> pd.Series:
        return pd.Series([codec(path, pattern).decode(x) for x in column], dtype=object)

    return raw(ids)


def round_trip(text: Column, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Column:
    """(ids, decoded): what :func:`encode` gives and what :func:`decode` makes of it, in one pass of one worker."""

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: pd.Series) -> pd.DataFrame:
        own = codec(path, pattern)
        ids = [own.encode(t) for t in texts]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([own.decode(x) for x in ids], dtype=object)})

    return both.asNondeterministic()(text)  # so that nothing that uses a part encodes once more


def id_array(ids: Column) -> Column:
    """Packed ids as an array of whole numbers, for use in SQL."""

    @F.pandas_udf("array<int>")
    def numbers(column: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x or b"", "<u4").astype("int32") for x in column], dtype=object)

    return numbers(ids)


def encoded_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: the number of ids, and digests of the ids and of what they decode to.

    Map-only. Null texts are empty; every row of ``docs`` gives one row.
    """
    rows = docs.select("doc_id", round_trip(text_or_empty(), path).alias("both")).select("doc_id", "both.*")
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
