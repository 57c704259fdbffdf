"""Removal of byte strings that occur more than once, in one document or in several."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import stored, text_bytes, text_or_empty
from lockstep.llm.suffixes import Shard

#: A string of this many bytes that starts at two places is removed at both.
LENGTH = 200
#: Bytes of the substrings of which each window's smallest, by hash, is its anchor.
GRAM = 40
#: Bytes hashed at once.
BLOCK = 1 << 19
#: Strings in a suffix array.
PER_SHARD = 4000

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(0, 1 << 62)) * 2 + 1
_MASK = (1 << 64) - 1
_POSITION = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def gram_hashes(data: np.ndarray, gram: int, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """A hash of each ``gram`` bytes in ``data``, the same wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: len(data) + 1 - gram]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def window_runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, anchor, start, count, text) of the runs of windows that share an anchor.

    ``data`` holds texts one after another, text k from ``bounds[k]`` to ``bounds[k + 1]``. A
    window is ``length`` bytes of one text; its anchor is the ``gram`` bytes in it with the
    smallest hash, the leftmost if there are several. Equal windows thus have equal anchors
    at equal places, and each window is in exactly one run. Runs also end at
    every ``BLOCK`` bytes of a long text.
    """
    powers = _powers(_BASE, BLOCK + length)
    inverse = _powers(pow(_BASE, -1, 1 << 64), BLOCK + length)
    width = length - gram + 1
    sizes = np.diff(bounds)
    k = 0
    while k < len(sizes):
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + BLOCK, "right")) - 1)
        if sizes[k] > BLOCK:
            blocks = [(bounds[k] + at, min(bounds[k] + at + BLOCK + length - 1, bounds[k + 1]), np.array([k])) for at in range(0, int(sizes[k]), BLOCK)]
            last = k + 1
        else:
            blocks = [(bounds[k], bounds[last], np.arange(k, last))]
        for low, high, texts in blocks:
            if high - low < length:
                continue
            h = gram_hashes(data[low:high], gram, powers, inverse)
            place = h & ~_POSITION | np.arange(len(h), dtype=np.uint64)
            best, span = place, 1
            while span * 2 <= width:
                best, span = np.minimum(best[:-span], best[span:]), span * 2
            if span < width:
                best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
            inside = np.zeros(len(best) + 1, np.int32)
            opens = np.maximum(bounds[texts], low) - low
            shuts = np.minimum(bounds[texts + 1], high) - low - length + 1
            some = shuts > opens
            np.add.at(inside, opens[some], 1)
            np.add.at(inside, shuts[some], -1)
            starts = np.flatnonzero(np.cumsum(inside[:-1]))
            if not len(starts):
                continue
            anchor = (best[starts] & _POSITION).astype(np.int64)
            heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            count = np.diff(np.append(heads, len(starts)))
            first = starts[heads] + low
            yield (
                h[anchor[heads]].view(np.int64),
                anchor[heads] + low,
                first,
                count,
                np.searchsorted(bounds, first, "right") - 1,
            )
        k = last


def _runs(length: int, gram: int):
    """Map of texts (x, y, text) to their runs (h, c, x, y, start, n). One text is done once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.select([0, 1]).to_pandas()
            batch = batch.take(pa.array(np.flatnonzero(~frame.duplicated().to_numpy())))
            data, bounds = text_bytes(batch.column(2))
            x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            view = memoryview(data)
            for h, anchor, first, count, text in window_runs(data, bounds, length, gram):
                ends = first + count + length - 1
                c = [
                    xxhash.xxh3_64_intdigest(view[a:b], s)
                    for a, b, s in zip(first.tolist(), ends.tolist(), (anchor - first).tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h),
                        pa.array(np.array(c, np.uint64).view(np.int64)),
                        pa.array(x[text]),
                        pa.array(y[text]),
                        pa.array(first - bounds[text]),
                        pa.array(count),
                    ],
                    names=["h", "c", "x", "y", "start", "n"],
                )

    return run


def text_key(text: Column) -> list[Column]:
    """Two numbers that stand for a text: a 64-bit hash, and its length beside its checksum."""
    raw = text.cast("binary")
    return [
        F.xxhash64(raw).alias("x"),
        (F.shiftleft(F.octet_length(raw).cast("long"), 32) + F.crc32(raw)).alias("y"),
    ]


def _shard_job(length: int):
    """The windows of a shard's strings that repeat: within it, or between the two parts ``p`` and ``q`` of it."""

    def windows(shard: Shard) -> np.ndarray:
        every = np.arange(len(shard.text))
        return every[every + length <= shard.ends]

    def spans(group: pd.DataFrame, shard: Shard, flags: np.ndarray) -> pd.DataFrame:
        edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a string's last bytes start no window, so a span never crosses into the next string
        string = np.searchsorted(shard.starts, low, "right") - 1
        return pd.DataFrame(
            {
                "h": group["h"].to_numpy()[string],
                "c": group["c"].to_numpy()[string],
                "low": low - shard.starts[string],
                "high": high - shard.starts[string],
            }
        )

    def built(group: pd.DataFrame) -> Shard:
        shard = Shard(group["bytes"].tolist(), length)
        shard.suffix_array()
        shard.common_prefixes()
        return shard

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first, second = group[group["part"] == group["p"]], group[group["part"] == group["q"]]
        if not len(first) or not len(second):
            return pd.DataFrame({"h": [], "c": [], "low": [], "high": []}).astype("int64")
        here = built(first)
        if group["p"].iat[0] == group["q"].iat[0]:
            return spans(first, here, here.repeated())
        there = Shard(second["bytes"].tolist(), length)
        asked = windows(there)
        found, hit = here.find(there, asked)
        flags = np.zeros(len(there.text), bool)
        flags[asked[found]] = True
        return pd.concat([spans(first, here, hit), spans(second, there, flags)])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, per_shard: int = PER_SHARD) -> DataFrame:
    """(x, y, copies, spans): for each distinct text its number of documents and where its repeated bytes are.

    ``docs`` has ``doc_id``, ``text`` without nulls, and the text's key ``x, y``. Spans are
    [low, high) byte ranges that may overlap. A text of several documents has none listed:
    all of it repeats if it is ``length`` bytes long.

    1. Windows of ``length`` bytes are gathered into runs around a content-defined anchor,
       so that equal windows meet under one anchor hash. Anchors seen once drop out.
    2. Runs equal in all their bytes repeat as a whole.
    3. Runs that differ under one anchor go into suffix arrays, one string for each distinct
       run, in shards of whole anchors. An anchor of more than ``per_shard`` different runs
       is split into parts: each is an array of its own, and every two parts are merged by
       binary search.

    Counting is aggregated before it is shuffled; whole rows are only met by joins, whose
    skewed keys Spark splits.
    """
    spark = docs.sparkSession
    runs = stored(
        docs.select("x", "y", "text").mapInArrow(_runs(length, gram), "h bigint, c bigint, x bigint, y bigint, start bigint, n bigint"),
        "runs",
    )
    again = runs.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h")
    live = stored(runs.join(again, "h").withColumn("at", F.xxhash64("x", "y", "start")), "live-runs")
    kinds = live.groupBy("h", "c").agg(
        F.min("at").alias("least"), F.max("at").alias("most"), F.min(F.struct("x", "y", "start", "n")).alias("one")
    )
    kinds = stored(
        kinds.select("h", "c", (F.col("least") != F.col("most")).alias("whole"), "one.x", "one.y", "one.start", "one.n"),
        "run-kinds",
    )
    mixed = kinds.groupBy("h").agg(
        F.count(F.lit(1)).alias("kinds"), F.min(F.col("whole").cast("int")).alias("all_whole")
    )
    mixed = mixed.where("kinds > 1 and all_whole = 0").select("h", "kinds")
    classes = docs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))
    classes = stored(classes, "text-classes")

    # one string for each kind of run, cut from one document that has it
    wanted = kinds.join(mixed, "h").join(classes.drop("copies"), ["x", "y"])
    per_text = wanted.groupBy("x", "y", "doc_id").agg(
        F.collect_list(F.struct("h", "c", "start", "n", "kinds")).alias("wanted")  # as many as the text has runs
    )
    a, b = docs.alias("a"), per_text.alias("b")
    same = (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    cut = a.join(b, same).select(F.col("a.text").cast("binary").alias("raw"), F.explode("b.wanted").alias("w"))
    strings = cut.select(
        "w.h", "w.c", "w.kinds", F.expr(f"substring(raw, cast(w.start + 1 as int), cast(w.n + {length - 1} as int))").alias("bytes")
    )
    strings = stored(strings, "run-strings")
    shards = max(1, 2 * strings.count() // per_shard)
    parts = F.ceil(F.col("kinds") / per_shard).cast("int")
    dealt = strings.select(
        "h",
        "c",
        "bytes",
        F.when(parts > 1, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards))).alias("shard"),
        F.when(parts > 1, F.pmod(F.xxhash64("c"), parts)).otherwise(F.lit(0)).cast("int").alias("part"),
        parts.alias("parts"),
    )
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        "h", "c", "bytes", "shard", "parts", "part", F.least("part", "_o").alias("p"), F.greatest("part", "_o").alias("q")
    )
    partial = dealt.groupBy("shard", "parts", "p", "q").applyInPandas(
        _shard_job(length), "h bigint, c bigint, low bigint, high bigint"
    )
    found = kinds.where("whole").select("h", "c", F.lit(0).cast("long").alias("low"), F.col("n").alias("high"))
    found = found.union(partial.join(kinds.where("not whole").select("h", "c"), ["h", "c"]).select("h", "c", "low", "high"))
    per_kind = live.join(stored(found, "repeated-runs"), ["h", "c"])
    spans = per_kind.groupBy("x", "y").agg(
        F.collect_set(  # as many as the text has runs, and parts of runs
            F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") + (length - 1)).alias("high"))
        ).alias("spans")
    )
    return classes.select("x", "y", "copies").join(spans, ["x", "y"], "left")


def _cleaned(length: int, as_text: bool):
    """Map of (..., raw, copies, spans) to (..., n_bytes, n_removed, n_spans, kept) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rest = [i for i, n in enumerate(names) if n not in ("text", "copies", "spans")]
            out = []
            for raw, copies, spans in zip(*(batch.column(names.index(n)) for n in ("text", "copies", "spans"))):
                raw = raw.as_buffer().to_pybytes() if len(raw.as_buffer()) else b""
                n = len(raw)
                if n >= length and copies.as_py() > 1:
                    joined = [(0, n)]
                else:
                    joined = merged([(s["low"], s["high"]) for s in spans.as_py() or []])
                kept, at = [], 0
                for low, high in joined:
                    kept.append(raw[at:low])
                    at = high
                kept = b"".join([*kept, raw[at:]])
                out.append((n, n - len(kept), len(joined), kept.decode(errors="ignore") if as_text else hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in rest] + [pa.array(v, t) for v, t in zip(columns, types)],
                names=[names[i] for i in rest] + ["n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined, in order."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def _cleaned_rows(docs: DataFrame, keep: list[str], length: int, as_text: bool) -> DataFrame:
    text = text_or_empty()
    keyed = docs.select(*keep, text.alias("text"), *text_key(text))
    ids = keyed.select("doc_id", "text", "x", "y")
    table = stored(repeated_spans(ids, length), "spans")
    rows = keyed.join(table, ["x", "y"], "left").select(*keep, "text", "copies", "spans")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return rows.mapInArrow(
        _cleaned(length, as_text), f"{schema}, n_bytes bigint, n_removed bigint, n_spans bigint, kept string"
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``text`` as it is without its repeated bytes, ``n_chars`` counted anew if it is there.

    All other columns stay. Where a removed run cuts a character in two, its remaining bytes go too.
    """
    keep = [c for c in docs.columns if c != "text"]
    internal = {c: f"_keep_{i}" for i, c in enumerate(keep) if c != "doc_id"}
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in internal.items()])
    rows = _cleaned_rows(renamed, ["doc_id", *internal.values()], length, True)
    back = {c: F.col(n) for c, n in internal.items()} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in internal:
        back["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[back[c].alias(c) for c in docs.columns])


def repeats_in_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: how many bytes and runs of bytes go, and a digest of the rest.

    Null texts are empty. Texts shorter than ``length`` bytes keep everything. Repeated rows
    count as documents of their own.
    """
    rows = _cleaned_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], length, False)
    return rows.withColumnRenamed("kept", "kept_sha256")
