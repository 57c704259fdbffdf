"""Training order by a keyed permutation, written as fixed-stride shards."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep.cluster import checkpoint_dir
from lockstep.llm.common import stored
from lockstep.llm.packing import END, HELD, LENGTH, VOCABULARY, cut, of_ids

ROUNDS = 6
KEY = "training-order-1"
#: Slots in a shard.
PER_SHARD = 1024
#: A record: doc_id, whether there is one, piece and number of ids, then the ids as unsigned 16-bit numbers, zeros behind them.
HEAD = np.dtype([("doc_id", "<i8"), ("known", "<i4"), ("piece", "<i4"), ("length", "<i4")])
FIELDS = "<qiii"
#: Bytes of records that a task writes, about, and the most tasks; with more records than that a task writes more.
PER_TASK, MOST_TASKS = 16 << 20, 20_000
#: Shards in a file, at most, so that no reader meets more of them at a time than its split holds.
PER_FILE = 32


def stride(length: int = LENGTH) -> int:
    return HEAD.itemsize + 2 * length


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, count: int, key: str = KEY, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to ``count`` - 1, or its inverse, at ``index``.

    A Feistel network over the smallest even number of bits that holds ``count`` numbers;
    results beyond them go through it again until they are inside, four times at
    most on average. No state is needed, so any slot can be found from its number alone.
    """
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    seed = hashlib.sha256(f"{key}/{count}".encode()).digest()
    keys = np.frombuffer(hashlib.shake_256(seed).digest(8 * ROUNDS), "<u8")
    out = np.asarray(index).astype(np.uint64)
    if len(out) and int(out.max()) >= count:
        raise ValueError("index out of range")
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mixed(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right ^ k) & mask)
        out[walking] = left << shift | right
        walking = walking[out[walking] >= np.uint64(count)]
    return out.astype(np.int64)


def with_slots(sequences: DataFrame, key: str = KEY) -> tuple[DataFrame, int]:
    """``sequences`` as a written table with ``slot``, and their number.

    A sequence's index is its place in that table, known from counts per part alone; its
    slot is the permuted index. Nothing is sorted or shuffled for it.
    """
    table = stored(sequences.withColumn("_at", F.monotonically_increasing_id()), "sequences")
    table = table.withColumn("_part", F.shiftright("_at", 33))
    runs = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("_part").alias("_run"), "_n", F.coalesce(before, F.lit(0)).alias("_before"))
    count = int(runs.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])

    @F.pandas_udf("bigint")
    def slot(index):
        import pandas as pd

        return pd.Series(permuted(index.to_numpy(), count, key))

    index = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    # one row for each part of the table
    placed = table.join(F.broadcast(runs), F.col("_part") == F.col("_run"))
    return placed.select(*sequences.columns, slot(index).alias("slot")), count


def records(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH, end: int = END) -> DataFrame:
    """(record): the sequences of every document, pieces of its ids and ``end``, as records without the zeros.

    Null texts are empty; a null doc_id is kept as such.
    """
    def rows(doc: int | None, packed: bytes) -> Iterator[tuple]:
        for k, (start, size) in enumerate(cut(len(packed) // 2, length)):
            yield (struct.pack(FIELDS, doc or 0, doc is not None, k, size) + packed[2 * start : 2 * (start + size)],)

    return of_ids(docs, rows, "record binary", path, end, False, "H", 2 * HELD)


def write_shards(sequences: DataFrame, path: str, key: str = KEY, length: int = LENGTH, per_shard: int = PER_SHARD) -> int:
    """Write ``sequences`` (record) in training order; returns their number.

    The table at ``path`` has a row for each shard: its number, its first slot, how many
    slots it has, and its payload, in which slot s is at byte ``(s - first_slot) *
    stride``. Every shard but the last has ``per_shard`` slots, so a reader finds any slot by
    arithmetic, reads on from there in order, and resumes where it stopped. Tasks hold
    ranges of shards in order, known from the number of sequences alone. No sequence may be longer than ``length``.
    """
    placed, count = with_slots(sequences.select("record"), key)
    size = stride(length)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def done() -> pa.RecordBatch:
            names = ["shard", "first_slot", "slots", "payload"]
            values = [[shard], [shard * per_shard], [len(parts)], [b"".join(parts)]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            for slot, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if slot // per_shard != shard:
                    if parts:
                        yield done()
                    shard, parts = slot // per_shard, []
                if len(record) > size:
                    raise ValueError("a sequence is too long")
                parts.append(record.ljust(size, b"\0"))
        if parts:
            yield done()

    shards = max(1, -(-count // per_shard))
    tasks = min(shards, MOST_TASKS, max(1, -(-count * size // PER_TASK)))
    task = F.floor(F.floor(F.col("slot") / per_shard) * tasks / shards).cast("int")
    dealt = placed.select("slot", "record").repartitionById(tasks, task).sortWithinPartitions("slot")
    dealt.mapInArrow(blocks, "shard bigint, first_slot bigint, slots bigint, payload binary").write.option(
        "compression", "zstd"
    ).option("maxRecordsPerFile", PER_FILE).parquet(path)
    return count


def read_shards(spark: SparkSession, path: str, first_slot: int = 0, length: int = LENGTH) -> DataFrame:
    """(slot, shard, offset, doc_id, piece, length, ids_crc32) of every record from ``first_slot`` on.

    Shards that end before are not read. ``offset`` is the record's place in its payload.
    """
    size = stride(length)

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, slots, payload in zip(*(c.to_pylist() for c in batch.columns)):
                table = np.frombuffer(payload, np.uint8).reshape(slots, size)
                head = table[:, : HEAD.itemsize].copy().view(HEAD).ravel()
                ids = table[:, HEAD.itemsize :].copy().view("<u2").astype("<u4")
                slot = first + np.arange(slots)
                crc = [zlib.crc32(row[:n].tobytes()) for row, n in zip(ids, head["length"])]
                keep = np.flatnonzero(slot >= first_slot)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot[keep]),
                        pa.array(np.full(len(keep), shard)),
                        pa.array((slot[keep] - first) * size),
                        pa.array(head["doc_id"][keep].astype("i8"), mask=head["known"][keep] == 0),
                        pa.array(head["piece"][keep].astype("i4")),
                        pa.array(head["length"][keep].astype("i8")),
                        pa.array(np.array(crc, np.int64)[keep]),
                    ],
                    names=["slot", "shard", "offset", "doc_id", "piece", "length", "ids_crc32"],
                )

    rows = spark.read.parquet(path).where(F.col("first_slot") + F.col("slots") > first_slot)
    return rows.select("shard", "first_slot", "slots", "payload").mapInArrow(
        taken_apart,
        "slot bigint, shard bigint, offset bigint, doc_id bigint, piece int, length bigint, ids_crc32 bigint",
    )


def ordered_documents(docs: DataFrame) -> DataFrame:
    """Every sequence of every document, read back from shards written in training order.

    A sequence is a piece of a document's ids, the last id ending the document. Null texts
    are empty; a null doc_id stays null; repeated rows get a slot each.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/shards-{uuid4().hex}"
    write_shards(records(docs), path)
    return read_shards(spark, path)
