"""What several operators share: written tables, gapless numbers, connected classes."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep.cluster import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared checkpoint folder and read again.

    Cuts lineage so that neither a lost executor nor a second use computes it anew.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often lambdas in the body use it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 0 without gaps within ``groups``, in ``order``.

    Rows are dealt by ranges of (groups, order), so one group may fill many
    tasks. Each task's rows of a group are consecutive; only one count per task and
    group is gathered to shift them. Rows equal in all given columns are numbered in
    any order.
    """
    keys = [*groups, *order]
    placed = stored(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_at", 33))
    # at most (tasks + groups) rows
    runs = placed.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    named = {k: f"_run_{k}" for k in [*groups, "_part"]}
    runs = runs.withColumn("_before", before).select("_first", "_before", *[F.col(k).alias(v) for k, v in named.items()])
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]
    return placed.join(F.broadcast(runs), same).select(
        *df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name)
    )


#: A written table of up to this many narrow rows is broadcast.
SMALL = 1_000_000


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table of numbers, for broadcast if its rows, counted, are few; a larger one is left to be shuffled."""
    return F.broadcast(table) if table.count() <= SMALL else table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins, as views of its buffers."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    return np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8), bounds


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node with an edge.

    Large-star and small-star rounds: every node links its larger neighbours to its
    smallest one, then the smaller ones likewise, until nothing changes. Edges are
    held as a written table per round; the driver sees a count only. A node with very
    many edges is met by aggregates and joins, never by a collected list.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b).distinct()
    now = stored(now, "edges")
    seen = None
    for _ in range(max_rounds):
        large = _star(now.union(now.select(b.alias("a"), a.alias("b"))), large=True)
        after = stored(_star(large, large=False), "edges")
        sign = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        now, seen = after, sign
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(b.alias("a")).distinct().select("a", F.col("a").alias("b"))
    return now.union(roots).select(a.alias("node"), b.alias("component")).distinct()


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b): neighbours b of a are linked to the smallest of them and a."""
    if not large:  # each edge seen from its larger end
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = pairs.join(least, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            linked.select(F.col("a"), F.col("m").alias("b"))
        )
    return out.where(F.col("a") != F.col("b")).distinct()
