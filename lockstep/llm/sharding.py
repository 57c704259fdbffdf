"""Weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import numbered, text_or_empty

#: Hex digits taken from a digest; 13 of them are 52 bits, which a double holds exactly.
DIGITS = 13


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) that wins the race for ``key``.

    Every shard draws an exponential time from a hash of the key and its own number,
    divided by its weight; the least time wins, and of equal times the lowest shard.
    A shard's share is its weight's share. A further shard only takes keys into itself.
    A null key has a place of its own. Weights must be above 0; there must be one at least.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("each shard needs a weight above 0")
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    times = []
    for shard, weight in enumerate(weights):
        digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{shard}"), text)), 1, DIGITS), 16, 10)
        draw = (digits.cast("double") + 0.5) / float(16**DIGITS)
        times.append(F.struct((-F.log(draw) / float(weight)).alias("time"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*times))["shard"]


def shards(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """``df`` with ``shard`` and, if ``grown`` weights are given, ``grown_shard``.

    No shuffle. Rows of one key go to one shard; input columns of these names are replaced.
    """
    out = df.withColumn("shard", rendezvous(F.col(key), weights))
    return out.withColumn("grown_shard", rendezvous(F.col(key), grown)) if grown else out


def sharded_documents(docs: DataFrame, count: int = 8) -> DataFrame:
    """One row per document: its shard of ``count`` equal ones, its gapless slot there, and its shard among one more.

    Only ids, sizes and checksums are shuffled, dealt by ranges of (shard, id), so a
    shard may be larger than a task. Null texts are empty; repeated rows get a slot each.
    """
    text = text_or_empty().cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = shards(rows, "doc_id", [1.0] * count, [1.0] * (count + 1))
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
