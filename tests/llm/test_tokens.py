import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lockstep.llm import bpe, packing, pretokens, training_order
from tests.llm.plain import awkward, documents, rows_by_id


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(packing.VOCABULARY)
    return out


ODD = ["", " ", "  \n\n a", "'s'll\t\t x  ", "日本語　テキスト", "՘࢏ xế \U0001f600\x1c1\x1f", "a" * 5000, "Ā▁<unk>"]


@pytest.mark.parametrize("text", ODD)
def test_codec_equals_tiktoken(reference, text):
    codec = bpe.codec(bpe.VOCABULARY, public_tokenizers.PATTERN)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_cache_starts_anew(reference):
    codec = bpe.codec(bpe.VOCABULARY, public_tokenizers.PATTERN)
    small = pretokens.CachedEncoder(public_tokenizers.PATTERN, codec._encode_pieces, limit=10)
    for text in ("some words here", "other words there", "some words here"):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_serialise_refuses_gaps():
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 1})


def test_encoded_documents(spark, reference):
    rows = awkward()
    got = rows_by_id(bpe.encoded_documents(documents(spark, rows).withColumn("ids", F.lit(1))))
    for i, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        assert got[i] == {
            "doc_id": i,
            "n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            "decoded_sha256": hashlib.sha256((text or "").encode()).hexdigest(),
        }


def test_ids_as_columns(spark, reference):
    df = spark.createDataFrame([("one two",), (None,)], "text string")
    found = df.select("text", bpe.id_array(bpe.encode(F.col("text"))).alias("ids")).collect()
    assert [r.ids for r in found] == [reference.encode_ordinary("one two"), []]


def test_packing_holds_every_id_once(spark, tokenizer):
    rows = awkward() + [(2, "repeated id", "en", "s", 1), (None, "no id", "en", "s", 1)]
    got = packing.packed_documents(documents(spark, rows)).collect()
    wanted = []
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        for k, (start, size) in enumerate(packing.cut(len(ids), packing.LENGTH)):
            wanted.append((i, k, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())))
            assert size == packing.LENGTH or k == 0
    key = str
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(wanted, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= packing.LENGTH


def test_sum_of_squares_places_each_by_its_rule():
    rng = np.random.default_rng(7)
    sizes, length = rng.integers(1, 31, 400), 30
    bins, offsets = packing.sum_of_squares(sizes, length)
    level = {}
    for size, b, at in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def total(levels):
            counts = np.bincount([length - v for v in levels if v < length], minlength=length)
            return int((counts**2).sum())

        now = list(level.values())
        sums = []
        for v in set(now):
            if v + size <= length:
                rest = list(now)
                rest.remove(v)
                sums.append(total([*rest, v + size]))
        best = min(sums, default=total([*now, size]))
        assert at == level.get(b, 0)
        level[b] = at + size
        assert total(level.values()) == best


def test_packing_wastes_little(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 1025, 4000))], "doc_id bigint, piece int, length bigint, ids_crc32 bigint")
    got = packing.pack(rows, per_group=1500)
    total = got.agg(F.sum("length")).first()[0]
    assert got.select("sequence_id").distinct().count() <= 1.02 * total / packing.LENGTH
    assert got.count() == 4000


def test_empty_tables(spark):
    none = documents(spark, [])
    assert bpe.encoded_documents(none).count() == 0
    assert packing.packed_documents(none).count() == 0
    assert training_order.ordered_documents(none).count() == 0


def test_slots_are_the_permuted_places(spark):
    rows = spark.range(500).select(F.col("id").cast("string").cast("binary").alias("record"))
    placed, count = training_order.with_slots(rows.coalesce(1), "k")
    slots = {int(bytes(r.record)): r.slot for r in placed.collect()}
    assert count == 500
    assert [slots[i] for i in range(500)] == training_order.permuted(np.arange(500), 500, "k").tolist()


def test_names_of_added_tokens(tokenizer):
    texts = ["first <|endoftext|> second", "<|endoftext|><|endoftext|>", "a <|endoftext|", "  <|endoftext|>\n\n x"]
    for plain in (False, True):
        own = packing._encoder(packing.VOCABULARY, public_tokenizers.PATTERN, plain)
        tokenizer.encode_special_tokens = plain
        for text in texts:
            assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    tokenizer.encode_special_tokens = False


def test_ids_equal_the_librarys_on_all_scripts(tokenizer):
    own = packing._encoder(packing.VOCABULARY, public_tokenizers.PATTERN)
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0xD800, 37), *range(0xE000, 0x110000, 211)]]
    rng = random.Random(3)
    rng.shuffle(points)
    for at in range(0, len(points), 400):
        text = "".join(x + rng.choice(["", " ", "a", "'s", "12"]) for x in points[at : at + 400])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("count", [1, 2, 3, 1000, 4097])
def test_permutation(count):
    index = np.arange(count)
    slots = training_order.permuted(index, count, "k")
    assert sorted(slots.tolist()) == index.tolist()
    assert (training_order.permuted(slots, count, "k", inverse=True) == index).all()
    if count > 100:
        assert (training_order.permuted(index, count, "other") != slots).mean() > 0.9
        assert abs(np.corrcoef(index, slots)[0, 1]) < 0.1


def test_shards_hold_every_sequence(spark, tmp_path):
    rows = awkward() + [(2, "repeated id", "en", "s", 1), (None, None, None, None, None)]
    docs = documents(spark, rows).withColumn("record", F.lit(1)).withColumn("slot", F.lit(1))
    source = packing.pieces(docs)
    path = str(tmp_path / "shards")
    count = training_order.write_shards(training_order.records(docs), path, per_shard=4)
    got = training_order.read_shards(spark, path).collect()
    assert sorted(r.slot for r in got) == list(range(count))
    assert all(r.shard == r.slot // 4 and r.offset == r.slot % 4 * training_order.stride() for r in got)
    key = str
    wanted = [(r.doc_id, r.piece, r.length, r.ids_crc32) for r in source.collect()]
    assert sorted([(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got], key=key) == sorted(wanted, key=key)
    whole = training_order.ordered_documents(documents(spark, rows)).collect()
    assert sorted([(r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole], key=key) == sorted(wanted, key=key)
    later = training_order.read_shards(spark, path, first_slot=6).collect()
    assert sorted(r.slot for r in later) == list(range(6, count))
