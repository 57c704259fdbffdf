"""Row guards and validations that stand between a source and the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.cluster import lookup
from lockstep.functions import trees
from lockstep.functions.identity import identity_from_object, supports_batch
from lockstep.model import MAX_DEPTH, METHOD_STRATEGY, MUTABLE_RESOURCE, PUT_OBJECT

ROUTES_SCHEMA = "strategy string, group string, version string, resource string"
VERSION_PATH = "/metadata/resourceVersion"


def depth_guard(df: DataFrame, limit: int = MAX_DEPTH, depth: str = "depth") -> DataFrame:
    """Stop messages that have been answered too many times."""
    return df.where(F.coalesce(F.col(depth), F.lit(0)) <= limit)


def drop_own_messages(df: DataFrame, own_key: str, column: str = "producer_key") -> DataFrame:
    """Drop what this side produced; rows without a key stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(own_key)))


def mute_accounts(df: DataFrame, accounts: Sequence[str], event: str = "event", kind: str = "kind") -> DataFrame:
    """Drop alert puts of the listed accounts; rows without account stay."""
    if not accounts:
        return df
    resource = F.substring_index(F.col(kind), "/", -1)
    muted = (F.col(event) == PUT_OBJECT) & (resource == MUTABLE_RESOURCE) & F.col("account").isin(*accounts)
    return df.where(~F.coalesce(muted, F.lit(False)))


def parse_limit(limit: int | str | None) -> int | None:
    """A byte limit; unset, unreadable and negative values mean none, zero is a limit."""
    try:
        number = int(limit)
    except (TypeError, ValueError):
        return None
    return number if number >= 0 else None


def size_guard(
    df: DataFrame, max_bytes: int | str | None, event: str = "event", payload: str = "payload"
) -> DataFrame:
    """Drop puts whose payload has more bytes than the limit."""
    limit = parse_limit(max_bytes)
    if limit is None:
        return df
    too_large = (F.col(event) == PUT_OBJECT) & (F.octet_length(payload) > limit)
    return df.where(~F.coalesce(too_large, F.lit(False)))


def version_only(change: str) -> str:
    """SQL test whether a patch in leaf form touches nothing but the version."""
    return f"(size({change}) = 1 AND {trees.leaf(change, VERSION_PATH)} IS NOT NULL)"


def drop_version_only(df: DataFrame, change: str = "change") -> DataFrame:
    return df.where(f"NOT {version_only(change)}")


def quarantine(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Split decoded messages into usable and rejected ones."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def validate_ingest(df: DataFrame, routes: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Status of each posted object, checked in this order.

    400 path shape, 405 method without any route, 404 no such route, 400 body
    missing, 500 body unreadable, 400 body of another kind, 202 accepted. The
    path is compared in lower case, the routes as configured.
    """
    spark: SparkSession = df.sparkSession
    known = sorted({(s.lower(), g, v, r) for s, g, v, r in routes})
    methods = sorted({k[0] for k in known})
    table = lookup(spark, known, ROUTES_SCHEMA).withColumn("_route", F.lit(True))

    parts = F.split(F.lower("path"), "/", -1)
    strategy = F.lower("method")
    for method, name in METHOD_STRATEGY.items():
        strategy = F.when(F.col("method") == method, name).otherwise(strategy)
    part = [F.try_element_at(F.col("_parts"), F.lit(i)) for i in range(1, 7)]
    shape = (
        (F.size("_parts") == 6)
        & (part[0] == "")
        & (part[1] == "apis")
        & (part[2] == "v1")
        & (part[3] != "")
        & (part[4] != "")
        & (part[5] != "")
    )
    ident = F.col("_id")
    mismatch = (
        (ident["group"] != F.col("_group"))
        | ~ident["version"].eqNullSafe(F.col("_version"))
        | (ident["resource"] != F.col("_resource"))
    )
    status = (
        F.when(~F.coalesce(F.col("_shape"), F.lit(False)), 400)
        .when(~F.col("_strategy").isin(*methods) if methods else F.lit(True), 405)
        .when(F.col("_route").isNull(), 404)
        .when(F.col("body").isNull(), 400)
        .when(ident.isNull() | (ident["resource"] == ""), 500)
        .when(mismatch, 400)
        .otherwise(202)
    )
    on = {"_strategy": "strategy", "_group": "group", "_version": "version", "_resource": "resource"}
    requests = (
        df.withColumn("_parts", parts)
        .withColumn("_shape", shape)
        .withColumns({"_strategy": strategy, "_group": part[3], "_version": part[4], "_resource": part[5]})
        .join(table.withColumnsRenamed({v: k for k, v in on.items()}), list(on), "left")
        # only routed requests are parsed
        .withColumn("_id", F.when(F.col("_route") & F.col("_shape"), identity_from_object("body")))
        .withColumn("status", status)
    )
    accepted = F.col("status") == 202
    return requests.select(
        *df.columns,
        "status",
        F.when(accepted, F.col("_strategy")).alias("strategy"),
        F.when(accepted, F.col("_id")).alias("identity"),
    )


def validate_connections(df: DataFrame) -> DataFrame:
    """Status of each connection attempt: 401 header missing, 424 unusable version, else 200."""
    missing = F.lit(False)
    for header in ("access_key", "account", "cluster"):
        missing = missing | (F.coalesce(F.col(header), F.lit("")) == "")
    status = F.when(missing, 401).when(F.col("version").eqNullSafe("invalid"), 424).otherwise(200)
    return df.withColumn("status", status)


def reconcile_targets(clients: DataFrame, now: datetime | Column, min_age_seconds: int) -> DataFrame:
    """Clients connected long enough whose version understands batches."""
    now = now if isinstance(now, Column) else F.lit(now)
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("connection_time").cast("timestamp"))
    return clients.where((age >= min_age_seconds * 1_000_000) & supports_batch(F.col("sync_version")))
