"""Connected clients: who is live, and what goes to whom.

Connection events have account, cluster, connection_id, connection_time, op
(connect or disconnect), ts and seq. They may arrive in any order of their
connection times; ts and seq give the order of arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.model import RECONCILIATION_REQUEST, RECONCILIATION_REQUEST_BATCH
from lockstep.operators.chunks import chunked
from lockstep.operators.ordered import micros, state_before
from lockstep.operators.scans import Steps, running

CLIENT = ["account", "cluster"]
CONNECTION = [*CLIENT, "connection_id", "connection_time"]

REPORT_FIELDS = [
    "account",
    "cluster",
    "sync_version",
    "helm_version",
    "connection_id",
    "connection_time",
    "git_version",
    "cloud_provider",
]


# An event reaches every live connection that isn't newer and leaves itself, or nothing, in its place. A
# sequence of events does the same with the greatest of their times, whichever connection it meets.
_EVENT = "struct<at:timestamp,connects:boolean,of:struct<connection_id:string,connection_time:timestamp,sync_version:string>>"


def _then(f: str, g: str) -> str:
    kept = f"{g}.reach IS NULL OR coalesce({f}.live.at > {g}.reach, false)"
    return f"named_struct('reach', greatest({f}.reach, {g}.reach), 'live', if({kept}, {f}.live, {g}.live))"


ARRIVALS = Steps(
    type=f"struct<reach:timestamp,live:{_EVENT}>",
    nothing="named_struct('reach', NULL, 'live', NULL)",
    lift=lambda e: f"named_struct('reach', {e}.at, 'live', if({e}.connects, {e}, NULL))",
    then=_then,
)


def connection_steps(
    events: DataFrame, order: Sequence[str] = ("ts", "seq"), held: DataFrame | None = None, ranges: int | None = None
) -> DataFrame:
    """Each event with the connection that is live when it comes, and the one that is live afterwards.

    Returns account, cluster, ``seq`` (struct of ``order``), ``event``, ``live``, ``left`` and ``accepted``. The
    structs ``event``, ``live`` and ``left`` have ``at`` (the connection time, the epoch if there is none), ``connects`` and
    ``of`` (the connection); no live connection is null. ``held`` are connections that are live
    before all events; they give no rows. An event with an older time than the live connection is refused.

    A busy client's events are composed in slices, so that they take many tasks and few rounds.
    """
    version = F.col("sync_version") if "sync_version" in events.columns else F.lit(None).cast("string")
    when = F.col("connection_time").cast("timestamp")

    def row(seq: Column, connects: Column, version: Column) -> list[Column | str]:
        of = F.struct(F.col("connection_id").cast("string").alias("connection_id"), when.alias("connection_time"), version.alias("sync_version"))
        at = F.coalesce(when, F.timestamp_micros(F.lit(0))).alias("at")
        return [*CLIENT, seq.alias("seq"), F.struct(at, connects.alias("connects"), of.alias("of")).cast(_EVENT).alias("event")]

    came = F.struct(F.lit(1).alias("_come"), *order)
    rows = events.select(*row(came, F.coalesce(F.col("op") == "connect", F.lit(False)), version))
    if held is not None:
        there = F.struct(F.lit(0).alias("_come"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in order])
        rows = rows.unionByName(held.select(*row(there, F.lit(True), F.col("sync_version"))))
    accepted = F.col("live").isNull() | (F.col("live.at") <= F.col("event.at"))
    return (
        running(rows, CLIENT, ARRIVALS, ranges=ranges)
        .where("seq._come = 1")
        .select(*CLIENT, F.struct(*[f"seq.{c}" for c in order]).alias("seq"), "event", "before.live")
        .withColumn("accepted", accepted)
        .withColumn("left", F.when(~F.col("accepted"), F.col("live")).when(F.col("event.connects"), F.col("event")))
    )


def live_connections(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per client the connection that is live after all events, arriving in the order of ts and seq.

    An event with an older connection time than the live connection is refused; a later
    arrival with the same connection time replaces it or ends it. Connects may arrive in
    any order of their connection times.

    An event that a later one reaches or exceeds in connection time leaves no trace. Of those that are left
    times fall in the order of arrival, and the first connect among them is accepted, whatever was
    live, and meets only older events afterwards. So this is a running maximum from the end, taken in
    ranges of equal size, and an aggregate: a busy client fills many tasks.
    """
    columns = events.columns
    rest = [c for c in columns if c not in CLIENT]
    at = F.coalesce(F.col("connection_time").cast("timestamp"), F.timestamp_micros(F.lit(0)))
    turned = events.withColumns(
        {"_when": at, "_back": F.timestamp_micros(-micros(F.col("ts"))), "_next": -F.col("seq")}
    )
    later = state_before(turned, CLIENT, "_back", "_next", "_later", F.col("_when"), how="max", ranges=ranges)
    left = later.where((F.col("op") == "connect") & (F.col("_later").isNull() | (F.col("_when") > F.col("_later"))))
    newest = left.groupBy(*CLIENT).agg(F.max_by(F.struct(*rest), "_when").alias("_c"))
    return newest.select(*CLIENT, "_c.*").select(*columns)


def connected_count(events: DataFrame) -> DataFrame:
    return live_connections(events).agg(F.count(F.lit(1)).alias("n_connected"))


def disconnect_counts(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Disconnections per client, counting those that ended a live connection, in any order of arrival."""
    steps = connection_steps(events, ranges=ranges)
    ended = steps.where(~F.col("event.connects") & F.col("live").isNotNull() & F.col("accepted"))
    return ended.groupBy(*CLIENT).agg(F.count(F.lit(1)).alias("n_disconnects"))


def route_to_connected(messages: DataFrame, clients: DataFrame) -> DataFrame:
    """Messages of live clients. Comes before decoding, so that other bodies are never parsed."""
    return messages.join(clients.select(*CLIENT), CLIENT, "left_semi")


def route_as_of(messages: DataFrame, events: DataFrame, ts: str = "ts", ranges: int | None = None) -> DataFrame:
    """Messages whose client was live when they came, for a log that is read again.

    A connection event of the same moment comes first. Messages without client or time, and those of clients that never
    connect, go before anything is ordered. The others meet the states of their client in
    ranges of equal size, so a busy client takes many tasks.
    """
    steps = connection_steps(events, ranges=ranges)
    states = steps.select(
        *CLIENT,
        F.col("seq.ts").cast("timestamp").alias("_at"),
        F.struct(F.lit(0).alias("late"), F.col("seq.seq").cast("bigint").alias("no")).alias("_no"),
        F.col("left").isNotNull().alias("_live"),
    )
    clients = events.where("op = 'connect'").select(*CLIENT).distinct()
    kept = messages.columns
    sent = messages.join(clients, CLIENT, "left_semi").select(
        *CLIENT,
        F.col(ts).cast("timestamp").alias("_at"),
        F.struct(F.lit(1).alias("late"), F.lit(None).cast("bigint").alias("no")).alias("_no"),
        F.struct(*kept).alias("_message"),
    )
    both = sent.where("_at IS NOT NULL").unionByName(states, allowMissingColumns=True)
    met = state_before(both, CLIENT, "_at", "_no", "_was", F.col("_live"), ranges=ranges)
    return met.where(F.col("_message").isNotNull() & F.col("_was")).select("_message.*")


def connected_report(clients: DataFrame, max_clients: int = 10_000) -> DataFrame:
    """The clients of each server and tick as one report, or several numbered parts when there are many."""
    have = [f for f in REPORT_FIELDS if f in clients.columns]
    return (
        chunked(clients, ["server", "tick"], max_clients, CLIENT)
        .groupBy("server", "tick", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*have))).alias("clients"))
        .withColumn("n_clients", F.size("clients"))
    )


def request_batch(targets: DataFrame, max_requests: int = 10_000) -> DataFrame:
    """One message with a request per client, in numbered parts when there are many; none without clients."""
    whole = targets.select(*CLIENT, F.lit(True).alias("server_initiated"))
    return (
        chunked(whole.withColumn("_all", F.lit(0)), ["_all"], max_requests, CLIENT)
        .groupBy("part")
        .agg(F.array_sort(F.collect_list(F.struct(*CLIENT, "server_initiated"))).alias("requests"))
        .withColumns({"n_requests": F.size("requests"), "event": F.lit(RECONCILIATION_REQUEST_BATCH)})
    )


def request_messages(targets: DataFrame) -> DataFrame:
    """One request message per client."""
    return targets.select(
        *CLIENT, F.lit(True).alias("server_initiated"), F.lit(RECONCILIATION_REQUEST).alias("event")
    )
