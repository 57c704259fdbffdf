"""Packing messages into batches and taking batches apart."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.functions.identity import parse_kind
from lockstep.model import BATCH_LISTS, RECONCILIATION_BATCH, RECONCILIATION_BODY, VERIFY_OBJECT

ITEM_FIELDS = {
    "seq": "bigint",
    "ns": "string",
    "name": "string",
    "version": "string",
    "checksum": "string",
    "base_object": "string",
    "patch": "string",
    "object": "string",
}


#: What a batch belongs to: the client and the message that its items answer.
OWNER = ["account", "cluster", "msg_id"]


def pack_batches(messages: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """One batch per client, message, kind and batch type, with one list per message type.

    ``seq`` orders the items of a list. ``by`` names what a batch belongs to; by default
    those of ``OWNER`` that the messages have. A batch is as large as what one message
    asked for, so it is never split. ``depth``, where there is one, is the deepest.
    """
    have = set(messages.columns)
    by = [c for c in OWNER if c in have] if by is None else list(by)
    deepest = [F.max("depth").alias("depth")] if "depth" in have else []
    item = F.struct(
        *[
            (F.col(f) if f in have else F.lit(None)).cast(t).alias(f)
            for f, t in ITEM_FIELDS.items()
        ]
    )
    lists = [
        F.array_sort(F.collect_list(F.when(F.col("event") == event, F.col("_item")))).alias(name)
        for name, event in BATCH_LISTS
    ]
    known = messages.where(F.col("event").isin(*[event for _, event in BATCH_LISTS]))
    return (
        known.withColumn("_item", item)
        .groupBy(*by, "kind", "batch_type")
        .agg(F.count(F.lit(1)).alias("n_items"), *deepest, *lists)
        .select(
            *by,
            "kind",
            "batch_type",
            *(["depth"] if deepest else []),
            "n_items",
            F.struct(*[F.col(name) for name, _ in BATCH_LISTS]).alias("items"),
        )
    )


def unpack_batches(batches: DataFrame) -> DataFrame:
    """Messages of the batches with their order: ``op_rank`` by list, then ``pos`` in the list."""
    rest = [c for c in batches.columns if c not in ("items", "n_items")]
    lists = ", ".join(
        f"transform(items.{name}, (x, i) -> "
        f"named_struct('op_rank', {rank}, 'pos', i, 'event', '{event}', 'item', x))"
        for rank, (name, event) in enumerate(BATCH_LISTS)
    )
    rows = F.expr(f"flatten(filter(array({lists}), l -> l IS NOT NULL))")
    return batches.select(*rest, F.explode(rows).alias("_m")).select(
        *rest, "_m.op_rank", "_m.pos", "_m.event", "_m.item.*"
    )


def unpack_reconciliation(requests: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Reconciliation requests as one checksum row per object, and the kinds that cannot be read.

    Bad kinds do not hold up the others. Rows carry the time ``ts`` of their request, if it has one.
    """
    when = ["ts"] * ("ts" in requests.columns)
    body = F.from_json(F.col(payload).cast("string"), RECONCILIATION_BODY)
    kinds = (
        requests.withColumn("_b", body)
        .select(
            F.col("_b.account").alias("account"),
            F.col("_b.cluster").alias("cluster"),
            F.col("_b.msgId").alias("msg_id"),
            F.coalesce(F.col("_b.depth"), F.lit(0)).alias("depth"),
            F.explode("_b.kindToObject").alias("kind", "_objects"),
            *when,
        )
    )
    good = parse_kind(F.col("kind")).isNotNull()
    rows = (
        kinds.where(good)
        .withColumn("_o", F.explode("_objects"))
        .select(
            "account",
            "cluster",
            "msg_id",
            "depth",
            "kind",
            F.lit(VERIFY_OBJECT).alias("event"),
            F.lit(RECONCILIATION_BATCH).alias("batch_type"),
            F.col("_o.namespace").alias("ns"),
            F.col("_o.name").alias("name"),
            F.col("_o.resourceVersion").alias("version"),
            F.col("_o.checksum").alias("checksum"),
            *when,
        )
    )
    rejected = kinds.where(~good).select(
        "account", "cluster", "msg_id", "kind", F.size("_objects").alias("n_objects")
    )
    return rows, rejected


def dispatch_batches(
    df: DataFrame, handlers: Mapping[str, Callable[[DataFrame], DataFrame]], column: str = "batch_type"
) -> tuple[DataFrame, DataFrame]:
    """Send each batch type through its handler; unknown types come back as rejected."""
    handled = None
    for batch_type, handler in handlers.items():
        branch = handler(df.where(F.col(column) == batch_type))
        handled = branch if handled is None else handled.unionByName(branch, allowMissingColumns=True)
    if handled is None:
        raise ValueError("at least one handler is needed")
    known = F.coalesce(F.col(column).isin(*handlers), F.lit(False))
    return handled, df.where(~known)
