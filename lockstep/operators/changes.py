"""Operators over change streams: bursts, classification and bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.cluster import checked_broadcast
from lockstep.functions import documents as docs
from lockstep.functions import trees
from lockstep.functions.identity import to_version
from lockstep.model import DEBOUNCE_SECONDS, DELETE_OBJECT, PATCH, VERIFY_OBJECT
from lockstep.operators.ordered import sessions, state_before
from lockstep.operators.paths import object_keys
from lockstep.operators.store import encode_changes


def debounce(
    changes: DataFrame,
    keys: Sequence[str] | None = None,
    ts: str = "ts",
    tiebreak: str = "seq",
    gap_seconds: int = DEBOUNCE_SECONDS,
) -> DataFrame:
    """The last change of every burst; each further change of the key restarts the wait.

    With columns account and cluster each client's objects have bursts of their own.
    """
    keys = keys or object_keys(changes)
    bursts = sessions(changes, keys, ts, tiebreak, gap_seconds)
    return bursts.select(*keys, "last_event.*", "n_events")


def change_ops(
    changes: DataFrame,
    kinds: DataFrame | None = None,
    keys: Sequence[str] | None = None,
    ts: str = "ts",
    tiebreak: str = "seq",
    ranges: int | None = None,
) -> DataFrame:
    """Messages for a watch stream with the columns ``op`` and ``doc``.

    Added: verify. Deleted: delete, and the object is no longer known. Modified:
    put when nothing is known, else a patch against the last modified state, or
    nothing when only the version moved. Added does not make an object known.
    Without ``kinds`` every kind is patched. With columns account and cluster each client's
    objects are known for themselves.
    """
    keys = keys or object_keys(changes)
    op = F.col("op")
    state = F.when(op == "Modified", F.struct(F.col("doc").alias("doc"))).when(
        op == "Deleted", F.struct(F.lit(None).cast("string").alias("doc"))
    )
    rows = state_before(changes, keys, ts, tiebreak, "_known", state, ranges=ranges)
    if kinds is None:
        rows = rows.withColumn("_strategy", F.lit(PATCH))
    else:
        rows = rows.join(kinds.select("kind", F.col("strategy").alias("_strategy")), "kind", "left")

    # one pass: without a strategy a row keeps its document whole
    rows = rows.where(op.isin("Added", "Modified", "Deleted")).withColumns(
        {
            "_strategy": F.when(op == "Modified", F.col("_strategy")),
            "doc": F.when(op != "Deleted", F.col("doc")),
            "_base": F.col("_known.doc"),
        }
    )
    return (
        encode_changes(rows, "_base", "_strategy")
        .withColumns(
            {
                "event": F.when(op == "Added", VERIFY_OBJECT)
                .when(op == "Deleted", DELETE_OBJECT)
                .otherwise(F.col("event")),
                "object": F.when(op == "Modified", F.col("object")),
            }
        )
        .drop("_base", "_strategy", "_known")
    )


def resume_points(snapshot: DataFrame) -> DataFrame:
    """Per kind, the highest version listed."""
    return snapshot.groupBy("kind").agg(F.max(to_version(F.col("version"))).alias("resume_version"))


def after_errors(
    changes: DataFrame, held: DataFrame | None = None, ts: str = "ts", tiebreak: str = "seq", ranges: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """A watch stream with a ``reason`` why a row isn't usable (null: it is), and how far each kind has come.

    An Error ends a kind's watch; the next one starts from the highest version seen, so changes that
    aren't newer than that are ``repeated``. Rows that are no change of an object are ``error`` or ``no object``. Within
    one watch versions may come in any order, and versions that are no whole numbers are never repeats.

    The second table (kind, top, resume) goes in as ``held`` with the rows that follow: ``top`` is the highest version
    seen, ``resume`` the one that the present watch started from. A kind may hold all
    rows: what came before is found in ranges of equal size.
    """
    names = changes.columns
    is_change = F.coalesce(F.col("op").isin("Added", "Modified", "Deleted"), F.lit(False))
    reason = F.when(~is_change, "error").when(F.col("name").isNull(), "no object")
    version = F.when(F.col("version").cast("string").rlike(trees.INTEGER), to_version(F.col("version").cast("string")))
    rows = changes.select(
        *["kind", ts, tiebreak],
        F.struct(*names).alias("_row"),
        reason.alias("_reason"),
        F.when(reason.isNull(), version).alias("_version"),
        F.coalesce(F.col("op") == "Error", F.lit(False)).alias("_ends"),
    )
    if held is not None:
        # as three rows before all others: what the watch started from, its start, and what it has seen
        order = [F.lit(None).cast(changes.schema[c].dataType) for c in (ts, tiebreak)]
        for no, value in enumerate(("resume", None, "top")):
            rows = rows.unionByName(
                held.select(
                    "kind",
                    order[0].alias(ts),
                    F.lit(no - 3).cast(changes.schema[tiebreak].dataType).alias(tiebreak),
                    (F.col(value) if value else F.lit(None)).cast("bigint").alias("_version"),
                    F.lit(value is None).alias("_ends"),
                ),
                allowMissingColumns=True,
            )
    seen = state_before(rows, ["kind"], ts, tiebreak, "_seen", F.col("_version"), how="max", ranges=ranges)
    at_end = F.when(F.col("_ends"), F.col("_seen"))
    known = state_before(seen, ["kind"], ts, tiebreak, "_from", at_end, how="max", ranges=ranges)
    repeated = F.coalesce(F.col("_version") <= F.col("_from"), F.lit(False))
    told = known.where(F.col("_row").isNotNull()).select(
        "_row.*", F.coalesce("_reason", F.when(repeated, "repeated")).alias("reason")
    )
    come = seen.groupBy("kind").agg(F.max("_version").alias("top"), F.max(at_end).alias("resume"))
    return told, come


def bootstrap(snapshot: DataFrame, changes: DataFrame, annotation: str | None = None) -> DataFrame:
    """Existing objects as verifications, followed by the changes newer than the listing.

    For kinds whose stream does not replay. A kind without any listed object
    streams from the start. An object that carries its checksum under the metadata annotation of
    that name is verified by it, as it is; all others by the checksum of their document. Versions
    that are no whole numbers can't be told older, so their changes all stay.
    """
    checksum = docs.checksum("doc")
    if annotation is not None:
        carried = F.get_json_object("doc", f"$.metadata.annotations['{annotation}']")
        checksum = F.coalesce(carried, checksum)
    listed = snapshot.select(*object_keys(snapshot), "version", F.lit(VERIFY_OBJECT).alias("op"), checksum.alias("checksum"))
    after = F.coalesce(F.col("resume_version"), F.lit(-1))
    version = F.col("version").cast("string")
    told_older = F.coalesce(version.rlike(trees.INTEGER), F.lit(False)) & (to_version(version) <= after)
    later = (
        changes.join(checked_broadcast(resume_points(snapshot)), "kind", "left")
        .where(~told_older)
        .drop("resume_version")
    )
    return listed.unionByName(later, allowMissingColumns=True)
