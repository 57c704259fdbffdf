"""Order-dependent building blocks that do not need one task per key.

A key may hold a large share of all rows, so nothing here sorts a whole key in
one task. Rows are cut into ranges of equal size, or into time slices; the window runs
inside them, and only summary rows are carried across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.cluster import cut


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def last_by_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key. An aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_last")).select(*keys, "_last.*")


def in_ranges(df: DataFrame, keys: Sequence[str], *order: str, ranges: int | None = None) -> DataFrame:
    """Add ``_part``: the number of the row's range of (keys, order), ranges being of equal size.

    The rows are written, so that whoever reads them sees the same bounds. Rows that are equal in keys
    and order share a range; a busy key fills many.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return cut(dealt.withColumn("_part", F.spark_partition_id()))


def state_before(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tiebreak: str,
    name: str,
    state: Column,
    how: str = "last",
    inclusive: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``name``: the last (or greatest) non-null ``state`` of the rows before this one.

    Windows run inside ranges of equal size. A range hands the state of its last key on, so what is
    carried is one row per range, however many keys there are. The result doesn't depend on ``ranges``.
    """
    rows = in_ranges(df.withColumn("_state", state), keys, ts, tiebreak, ranges=ranges)
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_part").orderBy(ts, tiebreak).rowsBetween(Window.unboundedPreceding, end)
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)

    if how == "last":
        summary = F.max_by("_state", F.when(F.col("_state").isNotNull(), F.struct(ts, tiebreak)))
        here, carried = F.last("_state", True).over(inside), F.last("_sum", True).over(across)
    else:
        summary = F.max("_state")
        here, carried = F.max("_state").over(inside), F.max("_sum").over(across)

    # one row per range: its last key, and the next range that isn't empty
    borders = (
        rows.groupBy("_part")
        .agg(F.max(F.struct(*keys)).alias("_key"))
        .withColumn("_into", F.lead("_part").over(Window.partitionBy(F.lit(0)).orderBy("_part")))
    )
    handed = (
        rows.join(F.broadcast(borders), "_part")
        .where(F.struct(*keys).eqNullSafe(F.col("_key")))
        .groupBy(*keys, "_part", "_into")
        .agg(summary.alias("_sum"))
        .select(*keys, F.col("_into").alias("_part"), carried.alias("_carried"))
    )
    both = F.coalesce("_here", "_carried") if how == "last" else F.greatest("_here", "_carried")
    return (
        rows.withColumn("_here", here)
        .join(handed, [*keys, "_part"], "left")
        .withColumn(name, both)
        .drop("_part", "_state", "_here", "_carried")
    )


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tiebreak: str,
    gap_seconds: int,
    slice_gaps: int = 4096,
) -> DataFrame:
    """Sessions per key: a row joins while it is at most ``gap_seconds`` after the one before.

    Returns keys, ``session_start``, ``session_end``, ``n_events`` and ``last_event``
    (struct of the other columns of the last row).

    Rows whose time falls into the same gap-wide cell always share a session, so
    cells are pre-aggregated before any ordering. Cells are then chained inside
    slices of ``slice_gaps`` cells, and only sessions that reach a slice border
    meet across slices: at most two per key and slice.
    """
    gap = gap_seconds * 1_000_000
    rest = [c for c in df.columns if c not in keys]
    cell = F.floor(micros(F.col(ts)) / F.lit(gap)).cast("bigint")
    cells = (
        df.withColumn("_cell", cell)
        .groupBy(*keys, "_cell")
        .agg(
            F.min(micros(F.col(ts))).alias("_from"),
            F.max(micros(F.col(ts))).alias("_to"),
            F.count(F.lit(1)).alias("_n"),
            F.max_by(F.struct(*rest), F.struct(ts, tiebreak)).alias("_last"),
        )
        .withColumn("_slice", F.floor(F.col("_cell") / F.lit(slice_gaps)).cast("bigint"))
    )

    def chain(parts: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("_from")
        starts = F.coalesce((F.col("_from") - F.lag("_to").over(w) > gap).cast("int"), F.lit(1))
        return (
            parts.withColumn("_starts", starts)
            .withColumn("_no", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*by, "_no")
            .agg(
                F.min("_from").alias("_from"),
                F.max("_to").alias("_to"),
                F.sum("_n").alias("_n"),
                F.max_by("_last", "_to").alias("_last"),
            )
            .drop("_no")
        )

    width = slice_gaps * gap
    low = F.col("_slice") * width
    border = (F.col("_from") - low <= gap) | (low + width - F.col("_to") <= gap)
    local = chain(cells, [*keys, "_slice"])
    # border sessions of a key form one group, every other session is its own
    group = F.when(~border, F.col("_from"))
    return chain(local.withColumn("_group", group), [*keys, "_group"]).select(
        *keys,
        F.timestamp_micros("_from").alias("session_start"),
        F.timestamp_micros("_to").alias("session_end"),
        F.col("_n").alias("n_events"),
        F.col("_last").alias("last_event"),
    )
