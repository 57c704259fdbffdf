"""Tokenised pieces packed into sequences by the sum of squares."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import stored, text_or_empty
from lockstep.llm.pretokens import CachedEncoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LENGTH = 1024
END = 2
#: Characters of pre-tokens whose ids a worker holds.
HELD = 6_000_000
#: Pieces packed together by one task. More of them waste less at their common end; fewer spread wider.
PER_GROUP = 60_000
#: Splits the sequence numbers of groups.
STRIDE = 1 << 32


class TextEncoder:
    """The ids that the tokenizers library gives for whole texts, without special tokens added.

    An added token of the vocabulary, such as the name of the end of a text, is that token
    also where a text spells it, as in the library; ``plain`` makes it ordinary text. What stands between
    such tokens is encoded pre-token by pre-token, each by the vocabulary's own model.
    """

    def __init__(self, path: str, pattern: str, plain: bool, kind: str, limit: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        added = {} if plain else {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.added = {name: array(kind, [i]).tobytes() for name, i in added.items()}
        self.names = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        # the characters that stand for bytes, as the library has them
        every = "".join(map(chr, [*range(0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x110000, 64)]))
        mapped = "".join(piece for piece, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(every))
        table = {byte: character for byte, character in zip(every.encode(), mapped)}
        model = tokenizer.model

        def encode_many(pieces: list[str]) -> Iterator[list[int]]:
            for piece in pieces:
                yield [token.id for token in model.tokenize(piece.encode().decode("latin-1").translate(table))]

        self.pieces = CachedEncoder(pattern, encode_many, limit, kind)

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of the type ``kind``; none for null."""
        if not text or self.names is None or not self.names.search(text):
            return self.pieces.encode(text)
        out, at = [], 0
        for name in self.names.finditer(text):
            out += [self.pieces.encode(text[at : name.start()]), self.added[name[0]]]
            at = name.end()
        return b"".join([*out, self.pieces.encode(text[at:])])


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, plain: bool = False, kind: str = "I", limit: int = HELD) -> TextEncoder:
    """One encoder, with its bounded cache, in a Python worker."""
    return TextEncoder(path, pattern, plain, kind, limit)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole pieces at the end, the rest, if any, first."""
    first = n % length or length
    return [(0, min(first, n))] + [(start, length) for start in range(first, n, length)]


def pieces(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH, end: int = END, plain: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and ``end``, cut where longer than ``length``.

    Null and empty texts are the end id alone. For ``plain`` see :class:`TextEncoder`. Map-only; rows
    come out in batches of bounded size.
    """

    def rows(doc: int | None, packed: bytes) -> Iterator[tuple]:
        for k, (start, size) in enumerate(cut(len(packed) // 4, length)):
            yield doc, k, start, size, zlib.crc32(packed[4 * start : 4 * (start + size)])

    return of_ids(docs, rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", path, end, plain, "I")


def of_ids(
    docs: DataFrame, rows: Callable[[int | None, bytes], Iterable[tuple]], schema: str, path: str, end: int, plain: bool, kind: str,
    limit: int = HELD,
) -> DataFrame:
    """The ``rows`` made of each document's id and the ids of its text and ``end``, numbers of the ``array`` type ``kind``."""
    tail = array(kind, [end]).tobytes()
    pattern = public_tokenizers.PATTERN
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = pa.schema([(name, types[t]) for name, t in (field.split() for field in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, plain, kind, limit)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                out: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out += rows(doc, encoder.encode(text.as_py()) + tail)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), fields.types)], schema=fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, placed one after another as they come.

    ``opened[g]`` is the number of open bins with a gap of ``g``. Each item goes into the
    open bin with which the sum of the squared numbers of open bins per gap becomes
    smallest, and into a new one where none has room: sequences are to be few, so a new
    bin doesn't compete. Of equal places the one with the smallest gap is taken. Bins of
    one gap are used last in, first out.
    """
    opened = np.zeros(length + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made, never = 0, np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        if size == length:
            bins[i], offsets[i], made = made, 0, made + 1
            continue
        # growth of the sum if a bin of gap g takes the item; gap 0 doesn't count
        gaps = opened[size:]
        left = opened[: length + 1 - size]
        growth = 2 * (left - gaps) + 2
        growth[0] = 1 - 2 * gaps[0]
        growth[gaps == 0] = never
        best = int(growth.argmin())
        gap = size + best if growth[best] < never else length
        if gap == length:
            chosen, made = made, made + 1
        else:
            chosen = stacks[gap].pop()
            opened[gap] -= 1
        bins[i], offsets[i] = chosen, length - gap
        if gap > size:
            stacks[gap - size].append(chosen)
            opened[gap - size] += 1
    return bins, offsets


def pack(rows: DataFrame, length: int = LENGTH, per_group: int = PER_GROUP) -> DataFrame:
    """``rows`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``; each sequence is filled from 0 without gaps.

    Pieces are dealt evenly over groups of about ``per_group`` by a hash of the whole row
    key, whatever their sizes, and each group packs its own, largest first. Only numbers
    move. A piece longer than ``length`` is an error of the caller. Repeated rows are packed
    like any others.
    """
    table = stored(rows, "pieces")
    groups = max(1, -(-table.count() // per_group))
    keyed = table.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in table.schema)}, sequence_id bigint, offset bigint"

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), length)
        group = group.drop(columns="_group")
        return group.assign(sequence_id=int(key[0]) * STRIDE + bins, offset=offsets)

    return keyed.groupBy("_group").applyInPandas(run, schema)


def packed_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Every piece of every document with its place: the rows of :func:`pieces` after :func:`pack`."""
    return pack(pieces(docs, path))
