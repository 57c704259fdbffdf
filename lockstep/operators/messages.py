"""Decoding, wrapping and counting of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.documents import is_valid, once
from lockstep.functions.identity import kind_text, parse_kind
from lockstep.model import (
    DELETE_OBJECT,
    EVENT_NAMES,
    EVENT_NUMBER,
    GET_OBJECT,
    LOG_BODY,
    PATCH_OBJECT,
    PUT_OBJECT,
    RECONCILIATION_REQUEST,
    SOCKET_BATCH,
    SOCKET_HEADER,
    SOCKET_ITEM,
    VERIFY_OBJECT,
)

LOG_EVENTS = [GET_OBJECT, PATCH_OBJECT, VERIFY_OBJECT, PUT_OBJECT, DELETE_OBJECT]


def event_name(number: Column) -> Column:
    """Name of an event number, null when out of range."""
    return F.try_element_at(F.array(*[F.lit(n) for n in EVENT_NAMES]), F.when(number >= 0, number + 1))


def event_number(name: Column) -> Column:
    pairs = [F.lit(x) for name_, number in EVENT_NUMBER.items() for x in (name_, number)]
    return F.try_element_at(F.create_map(*pairs), name)


def decode_socket_messages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Socket messages: header first, then the body the event calls for.

    Adds ``depth``, ``msg_id``, ``event``, ``kind``, the body columns, ``batch`` and
    ``error``. Empty, undecodable and unknown messages carry an error; a ping has
    neither body nor error.
    """
    text = F.col(payload).cast("string")
    header = F.from_json(text, SOCKET_HEADER, {"mode": "PERMISSIVE"})
    name = event_name(F.col("_h.Event"))
    item_events = ["newChecksum", "objectDeleted", "getObject", "patchObject", "putObject"]
    item = F.when(F.col("event").isin(*item_events), F.from_json(text, SOCKET_ITEM))
    batch = F.when(F.col("event") == "batch", F.from_json(text, SOCKET_BATCH))
    error = (
        F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, "empty")
        .when(~is_valid(f"cast({payload} AS STRING)"), "undecodable")
        .when(F.col("_h.Event").isNull(), "no event")
        .when(F.col("event").isNull(), "unknown event")
    )
    kind = F.col("_h.Kind")
    parsed = once(df.withColumn("_h", header).withColumn("event", name), "error", error)
    return (
        parsed.withColumns({"_b": item, "batch": batch})
        .withColumns(
            {
                "depth": F.coalesce(F.col("_h.Depth"), F.lit(0)),
                "msg_id": F.col("_h.MsgId"),
                "kind": F.when(kind.isNotNull(), kind_text(kind["Group"], kind["Version"], kind["Resource"])),
                # a cluster-wide object has no namespace on the wire and an empty one here
                "ns": F.when(F.col("_b").isNotNull(), F.coalesce("_b.Namespace", F.lit(""))),
                "name": F.col("_b.Name"),
                "version": F.col("_b.ResourceVersion"),
                "checksum": F.col("_b.Checksum"),
                "base_object": F.col("_b.BaseObject"),
                "patch": F.col("_b.Patch"),
                "object": F.col("_b.Object"),
            }
        )
        .drop("_h", "_b")
    )


def decode_log_messages(df: DataFrame, payload: str = "payload", event: str = "event") -> DataFrame:
    """Log messages, decoded by their event property; byte fields are base64 text.

    A put carries its object in the field ``patch``.
    """
    text = F.col(payload).cast("string")
    known = F.col(event).isin(*LOG_EVENTS, RECONCILIATION_REQUEST)
    body = F.when(F.col(event).isin(*LOG_EVENTS), F.from_json(text, LOG_BODY))

    def raw(field: str) -> Column:
        return F.try_to_binary(F.col(f"_b.{field}"), F.lit("base64")).cast("string")

    bad_kind = F.col("_b").isNotNull() & parse_kind(F.col("_b.kind")).isNull()
    error = (
        F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, "empty")
        .when(~is_valid(f"cast({payload} AS STRING)"), "undecodable")
        .when(~F.coalesce(known, F.lit(False)), "unknown event")
        .when(bad_kind, "unknown kind")
    )
    return (
        once(df.withColumn("_b", body), "error", error)
        .withColumns(
            {
                "msg_id": F.col("_b.msgId"),
                "depth": F.coalesce(F.col("_b.depth"), F.lit(0)),
                "kind": F.col("_b.kind"),
                "ns": F.when(F.col("_b").isNotNull(), F.coalesce("_b.namespace", F.lit(""))),
                "name": F.col("_b.name"),
                "version": F.col("_b.resourceVersion"),
                "checksum": F.col("_b.checksum"),
                "base_object": raw("baseObject"),
                "patch": F.when(F.col(event) == PATCH_OBJECT, raw("patch")),
                "object": F.when(F.col(event) == PUT_OBJECT, raw("patch")),
            }
        )
        .drop("_b")
    )


def log_body(df: DataFrame, event: str = "event") -> Column:
    """JSON body of a log message, from the wide message columns that are present."""
    have = set(df.columns)

    def column(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    def for_events(names: list[str], value: Column) -> Column:
        return F.when(F.col(event).isin(*names), value)

    def bytes_of(name: str) -> Column:
        return F.base64(column(name).cast("binary"))

    put_or_patch = F.when(F.col(event) == PUT_OBJECT, bytes_of("object")).when(
        F.col(event) == PATCH_OBJECT, bytes_of("patch")
    )
    return F.to_json(
        F.struct(
            F.col("account"),
            F.col("cluster"),
            F.col("depth"),
            F.col("kind"),
            F.col("msg_id").cast("string").alias("msgId"),
            F.col("name"),
            F.col("ns").alias("namespace"),
            # sent bodies never carry a version, the properties do
            F.lit(0).alias("resourceVersion"),
            for_events([VERIFY_OBJECT, PATCH_OBJECT, PUT_OBJECT], column("checksum")).alias("checksum"),
            for_events([GET_OBJECT], bytes_of("base_object")).alias("baseObject"),
            put_or_patch.alias("patch"),
        )
    )


def envelope(
    df: DataFrame,
    own_key: str,
    payload: Column | None = None,
    extra: Column | None = None,
    ts: str = "ts",
    event: str = "event",
) -> DataFrame:
    """Rows of the message log: key, properties, payload, ts.

    Properties, weakest first: timestamp and event, the object's identity, the
    caller's ``extra`` map, a non-empty account and cluster.
    """
    kind = parse_kind(F.col("kind"))
    version = F.col("version") if "version" in df.columns else F.lit(0)

    def override(low: Column, high: Column) -> Column:
        return F.map_zip_with(low, high, lambda k, a, b: F.coalesce(b, a))

    stamp = F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    properties = F.create_map(F.lit("timestamp"), stamp, F.lit("event"), F.col(event))
    identity = F.create_map(
        F.lit("group"),
        kind["group"],
        F.lit("version"),
        kind["version"],
        F.lit("resource"),
        kind["resource"],
        F.lit("name"),
        F.col("name").cast("string"),
        F.lit("namespace"),
        F.col("ns"),
        F.lit("resourceVersion"),
        F.coalesce(version.cast("string"), F.lit("0")),
    )
    properties = override(properties, F.map_filter(identity, lambda k, v: v.isNotNull()))
    if extra is not None:
        properties = override(properties, extra)
    owner = F.create_map(F.lit("account"), F.col("account"), F.lit("cluster"), F.col("cluster"))
    properties = override(properties, F.map_filter(owner, lambda k, v: F.coalesce(v, F.lit("")) != ""))
    return df.select(
        F.lit(own_key).alias("key"),
        properties.alias("properties"),
        (log_body(df, event) if payload is None else payload).alias("payload"),
        F.col(ts).alias("ts"),
    )


def message_metrics(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Messages and payload bytes by status, event type, kind, account and cluster."""
    return df.groupBy("status", "event_type", "kind", "account", "cluster").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).cast("bigint").alias("payload_bytes"),
    )


def merge_message_streams(*flows: DataFrame) -> DataFrame:
    """Several flows as one; columns a flow lacks are null."""
    merged = flows[0]
    for flow in flows[1:]:
        merged = merged.unionByName(flow, allowMissingColumns=True)
    return merged
