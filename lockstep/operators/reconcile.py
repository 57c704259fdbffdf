"""Three-way comparison of two snapshots, and key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.identity import to_version
from lockstep.operators.paths import KEYS

DELETE, PUT, VERIFY, SKIP = "delete", "put", "verify", "skip"


def keys_only_in(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).subtract(b.select(*keys))


def keys_common(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct keys both sides have."""
    return a.select(*keys).intersect(b.select(*keys))


def _op() -> Column:
    return (
        F.when(F.col("source_version").isNull(), DELETE)
        .when(F.col("target_version").isNull(), F.when(F.col("_in"), VERIFY).otherwise(SKIP))
        .when(F.col("source_version") != F.col("target_version"), PUT)
        .otherwise(SKIP)
    )


def reconcile(
    source: DataFrame,
    target: DataFrame,
    scope: Column | None = None,
    allow_empty: bool = False,
    keep_skips: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """What the target needs to equal the source: delete, put or verify, per key.

    Keys of both sides are put when their versions differ; checksums are not
    looked at. Keys only the source has are verified if they are in ``scope``, a
    condition on source columns. Versions that are no integers count as 0.

    An empty target is refused unless ``allow_empty``, because it would ask for
    everything. Only keys and versions meet in the join: fetch documents for the
    rows that need one with ``with_documents``.
    """
    if not allow_empty and target.limit(1).isEmpty():
        raise ValueError("reconciliation against an empty target; pass allow_empty=True if that is meant")
    in_scope = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    s = source.select(*keys, to_version(F.col("version")).alias("source_version"), in_scope.alias("_in"))
    t = target.select(*keys, to_version(F.col("version")).alias("target_version"))
    plan = s.join(t, list(keys), "full_outer").select(*keys, _op().alias("op"), "source_version", "target_version")
    return plan if keep_skips else plan.where(F.col("op") != SKIP)


def with_documents(plan: DataFrame, source: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Put and verify rows of a plan with the source's document, deletes without one."""
    return plan.join(source.select(*keys, "doc"), list(keys), "left")


def reconciled(
    source: DataFrame, target: DataFrame, scope: Column | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The target after one whole exchange: deletes done, puts stored, verifications answered.

    Both sides meet in a single join, so no object is shuffled more than once.
    """
    rest = [c for c in target.columns if c not in keys]
    in_scope = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    s = source.select(
        *keys, to_version(F.col("version")).alias("source_version"), in_scope.alias("_in"), F.struct(*rest).alias("_s")
    )
    t = target.select(*keys, to_version(F.col("version")).alias("target_version"), F.struct(*rest).alias("_t"))
    after = F.when(F.col("op").isin(PUT, VERIFY), F.col("_s")).when(F.col("op") == SKIP, F.col("_t"))
    return (
        s.join(t, list(keys), "full_outer")
        .withColumn("op", _op())
        .withColumn("_after", after)
        .where(F.col("_after").isNotNull())
        .select(*keys, "_after.*")
    )
