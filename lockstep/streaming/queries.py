"""Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lockstep.cluster import cut
from lockstep.model import (
    CONNECTED_CLIENTS,
    DEBOUNCE_SECONDS,
    DELETE_OBJECT,
    GET_OBJECT,
    PATCH_OBJECT,
    PUT_OBJECT,
    SERVER_CONNECTED,
    VERIFY_OBJECT,
)
from lockstep.operators.changes import after_errors, change_ops
from lockstep.operators.clients import CLIENT, connection_steps, request_messages
from lockstep.operators.guards import reconcile_targets
from lockstep.operators.messages import merge_message_streams
from lockstep.operators.ordered import last_by_key, micros, sessions
from lockstep.operators.paths import KEYS, object_keys
from lockstep.operators.reconcile import reconcile
from lockstep.streaming.state import KeyedState

Sink = Callable[[DataFrame, int], None]

# The first microsecond of year 1: a known state came before every change.
EARLIEST = -62_135_596_800_000_000

KNOWN_SCHEMA = "kind string, ns string, name string, doc string, live boolean"
CLIENT_SCHEMA = (
    "account string, cluster string, connection_id string, connection_time timestamp, sync_version string, live boolean"
)


class Handlers(Protocol):
    """What a side does with each kind of message; every member maps a DataFrame to a DataFrame.

    Use with ``DataFrame.transform`` in batch, or inside ``foreachBatch``.
    """

    def delete(self, messages: DataFrame) -> DataFrame: ...
    def get(self, messages: DataFrame) -> DataFrame: ...
    def patch(self, messages: DataFrame) -> DataFrame: ...
    def put(self, messages: DataFrame) -> DataFrame: ...
    def verify(self, messages: DataFrame) -> DataFrame: ...
    def batch(self, messages: DataFrame) -> DataFrame: ...


#: Messages that handlers exist for, and the handlers' names, in the order they are asked.
EVENTS = {
    DELETE_OBJECT: "delete",
    GET_OBJECT: "get",
    PATCH_OBJECT: "patch",
    PUT_OBJECT: "put",
    VERIFY_OBJECT: "verify",
    "batch": "batch",
}


def handle(messages: DataFrame, handlers: Handlers, events: Collection[str | None] = EVENTS) -> DataFrame:
    """All messages through the handler of their event, as one flow.

    ``events`` names those that occur, where that is known: there is no work for the others.
    """
    answers = [
        messages.where(F.col("event") == event).transform(getattr(handlers, name))
        for event, name in EVENTS.items()
        if event in events
    ]
    return merge_message_streams(*answers) if answers else messages.where(F.lit(False))


def run(df: DataFrame, checkpoint: str, each: Sink, interval: str | None = None) -> StreamingQuery:
    """Run ``each`` per micro-batch: over what is there now, or on a timer with ``interval``."""
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


@dataclass(frozen=True)
class OpenBursts:
    """Bursts that a later change may still extend, and how far the stream has come, in shared storage."""

    path: str
    keys: Sequence[str]
    rest: str
    ts: str = "ts"
    tiebreak: str = "seq"
    gap_seconds: int = DEBOUNCE_SECONDS

    @property
    def _state(self) -> KeyedState:
        keys = ", ".join(f"{k} string" for k in self.keys)
        return KeyedState(f"{self.path}/bursts", list(self.keys), f"{keys}, bursts array<{self._burst}>, live boolean")

    @property
    def _burst(self) -> str:
        return f"struct<low:bigint,high:bigint,n:bigint,last:struct<{self.rest}>>"

    def _clock(self, batch_id: int) -> str:
        return f"{self.path}/clock/batch={batch_id}"

    def border(self, spark: SparkSession, batch_id: int) -> int:
        """Before this microsecond the bursts that were over when ``batch_id`` began have been given out."""
        if batch_id == 0:
            return EARLIEST
        return spark.read.schema("border bigint").parquet(self._clock(batch_id - 1)).first()["border"]

    def advance(self, spark: SparkSession, new: DataFrame | None, batch_id: int, border: int) -> DataFrame:
        """Take in the bursts ``new`` (keys, low, high, n, last) and give out those that are over at ``border``.

        A key's bursts that are still open lie within the time that changes may be late, so there are few of them.
        """
        state = self._state
        held = state.before(spark, batch_id).select(*self.keys, F.explode("bursts").alias("_b")).select(*self.keys, "_b.*")
        every = held if new is None else held.unionByName(new)
        gap = self.gap_seconds * 1_000_000
        by_key = Window.partitionBy(*self.keys).orderBy("low")
        reach = F.max("high").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
        starts = F.coalesce((F.col("low") - reach > gap).cast("int"), F.lit(1))
        merged = every.withColumn("_starts", starts).withColumn(
            "_no", F.sum("_starts").over(by_key.rowsBetween(Window.unboundedPreceding, 0))
        )
        last = F.max_by("last", F.struct(F.col(f"last.{self.ts}"), F.col(f"last.{self.tiebreak}")))
        merged = merged.groupBy(*self.keys, "_no").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), last.alias("last")
        )
        merged = cut(merged.withColumn("_over", F.col("high") + gap < border))
        left = merged.where(~F.col("_over")).groupBy(*self.keys).agg(F.collect_list(F.struct("low", "high", "n", "last")).alias("bursts"))
        gone = held.select(*self.keys).distinct().join(left.select(*self.keys), list(self.keys), "left_anti")
        none = F.lit(None).cast(f"array<{self._burst}>")
        rows = left.withColumn("live", F.lit(True)).unionByName(gone.select(*self.keys, none.alias("bursts"), F.lit(False).alias("live")))
        state.write(spark, rows, batch_id)
        spark.createDataFrame([(border,)], "border bigint").coalesce(1).write.mode("overwrite").parquet(self._clock(batch_id))
        return merged.where("_over").select(*self.keys, "last.*", F.col("n").alias("n_events"))


def open_bursts(
    changes: DataFrame,
    path: str,
    keys: Sequence[str] | None = None,
    ts: str = "ts",
    tiebreak: str = "seq",
    gap_seconds: int = DEBOUNCE_SECONDS,
) -> OpenBursts:
    """The open bursts of a stream of rows like ``changes``, kept at ``path``. Keys are texts."""
    keys = list(keys or object_keys(changes))
    rest = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in changes.schema.fields if f.name not in keys)
    return OpenBursts(path, keys, rest, ts, tiebreak, gap_seconds)


def stream_debounce(
    changes: DataFrame,
    bursts: OpenBursts,
    checkpoint: str,
    sink: Sink,
    late: Sink,
    delay_seconds: int = 600,
    interval: str | None = None,
) -> StreamingQuery:
    """The last change of every burst, given out once the burst is over.

    A burst is over when changes ``delay_seconds`` older than the newest one can't extend it. Changes that are
    older still, and so might belong to a burst already given out, go to ``late`` as they are.
    What is open when the stream ends stays in ``bursts`` for the next run, or :func:`close_bursts` gives it
    out. Each batch is reduced to its own bursts first, so a busy key shrinks before it meets the open ones.
    """
    keys, gap = bursts.keys, bursts.gap_seconds

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        at = micros(F.col(bursts.ts))
        border = bursts.border(spark, batch_id)
        newest = batch.agg(F.max(at).alias("at")).first()["at"]
        late(batch.where(at < border), batch_id)
        found = sessions(batch.where(at >= border), keys, bursts.ts, bursts.tiebreak, gap)
        new = found.select(
            *keys, micros(F.col("session_start")).alias("low"), micros(F.col("session_end")).alias("high"),
            F.col("n_events").alias("n"), F.col("last_event").alias("last"),
        )
        after = border if newest is None else max(border, newest - delay_seconds * 1_000_000)
        sink(bursts.advance(spark, new, batch_id, after), batch_id)
        batch.unpersist()

    return run(changes, checkpoint, each, interval)


def close_bursts(spark: SparkSession, bursts: OpenBursts, batch_id: int, sink: Sink, now: int | None = None) -> None:
    """Give out the bursts that are over at microsecond ``now``, all of them without it, as batch ``batch_id``, the one after the last.

    For the end of a stream, or for a timer where changes stay away. A stream goes on after it from a new checkpoint only.
    """
    border = bursts.border(spark, batch_id)
    later = (1 << 62) if now is None else max(border, now)
    sink(bursts.advance(spark, None, batch_id, later), batch_id)


def stream_change_ops(
    changes: DataFrame,
    state_path: str,
    checkpoint: str,
    sink: Sink,
    kinds: DataFrame | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """``change_ops`` on a stream; the last sent state of each object is kept between batches.

    Input has kind, ns, name, op, doc, ts, seq. Only objects a batch touches are
    taken from the state. With account and cluster each client's objects are known for themselves.
    """
    keys = object_keys(changes)
    owner = "".join(f"{k} string, " for k in keys if k not in KEYS)
    state = KeyedState(state_path, keys, owner + KNOWN_SCHEMA)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        held = state.before(spark, batch_id, batch)
        # known states enter as changes that came before everything in the batch
        seeds = held.select(
            *keys,
            F.lit("Modified").alias("op"),
            "doc",
            F.timestamp_micros(F.lit(EARLIEST)).cast(batch.schema["ts"].dataType).alias("ts"),
            F.lit(-(1 << 63)).cast("bigint").alias("seq"),
            F.lit(True).alias("_seed"),
        )
        sent = change_ops(batch.unionByName(seeds, allowMissingColumns=True), kinds, keys)
        sink(sent.where(F.col("_seed").isNull()).drop("_seed"), batch_id)
        told = batch.where(F.col("op").isin("Modified", "Deleted")).select(*keys, "op", "doc", "ts", "seq")
        touched = last_by_key(told, keys, "ts", "seq").select(
            *keys, F.when(F.col("op") == "Modified", F.col("doc")).alias("doc"), (F.col("op") == "Modified").alias("live")
        )
        state.write(spark, touched, batch_id)
        batch.unpersist()

    return run(changes, checkpoint, each, interval)


def stream_connections(
    events: DataFrame, state_path: str, checkpoint: str, sink: Sink, interval: str | None = None
) -> StreamingQuery:
    """The table of live clients, folded connection event by connection event.

    The sink gets a row per accepted connect (with its one-client report) and per
    disconnect of a live client; events that share a ``seq`` are each told once. Read the
    table with ``connection_state(path)``.
    """
    state = connection_state(state_path)
    fields = ["connection_id", "connection_time", "sync_version"]

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        clients = batch.select(*CLIENT).distinct()
        held = state.before(spark, batch_id, clients).where("live")
        steps = cut(connection_steps(batch, ["seq"], held))
        connects = F.col("event.connects")
        rows = steps.where(F.col("accepted") & (connects | F.col("live").isNotNull())).select(
            *CLIENT,
            "seq.seq",
            F.when(connects, SERVER_CONNECTED).otherwise("Disconnected").alias("event"),
            *[F.col(f"event.of.{f}").alias(f) for f in fields],
            F.when(connects, CONNECTED_CLIENTS).alias("report"),
        )
        sink(rows, batch_id)
        # a null that is the last state must win over a state before it
        last = F.max_by(F.struct("left"), F.struct("seq", "event")).alias("_last")
        after = steps.groupBy(*CLIENT).agg(last).select(*CLIENT, F.col("_last.left").alias("left"))
        live = F.col("left").isNotNull().alias("live")
        state.write(spark, after.select(*CLIENT, *[F.col(f"left.of.{f}").alias(f) for f in fields], live), batch_id)
        batch.unpersist()

    return run(events, checkpoint, each, interval)


def stream_changes(
    changes: DataFrame, state_path: str, checkpoint: str, usable: Sink, rejected: Sink, interval: str | None = None
) -> StreamingQuery:
    """A watch stream into two sinks: changes to use, and all other rows with their ``reason``.

    See ``after_errors``: a watch that an Error ended goes on from the highest version seen, also over a
    restart of the query, and what it repeats is rejected. Both sinks get every batch with its id and
    must replace a batch that comes again. The state is a row per kind.
    """
    state = watch_state(state_path)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kinds = batch.select("kind").distinct()
        held = state.before(spark, batch_id, kinds).drop("live")
        told, come = after_errors(batch, held)
        told = told.persist()
        usable(told.where("reason IS NULL").drop("reason"), batch_id)
        rejected(told.where("reason IS NOT NULL"), batch_id)
        told.unpersist()
        state.write(spark, come.withColumn("live", F.lit(True)), batch_id)

    return run(changes, checkpoint, each, interval)


def watch_state(path: str) -> KeyedState:
    return KeyedState(path, ["kind"], "kind string, top bigint, resume bigint, live boolean", buckets=4)


def connection_state(path: str) -> KeyedState:
    return KeyedState(path, CLIENT, CLIENT_SCHEMA)


@dataclass
class ReconcileTick:
    """What one tick of the periodic reconciliation produced."""

    requests: DataFrame
    plan: DataFrame


def reconcile_tick(
    clients: DataFrame, source: DataFrame, target: DataFrame, now: Column, min_age_seconds: int
) -> ReconcileTick:
    """Requests for the clients that are due, and the plan for their objects.

    Source and target carry account and cluster beside the object key.
    """
    due = reconcile_targets(clients, now, min_age_seconds)
    requests = request_messages(due)
    who = due.select(*CLIENT).distinct()
    mine = source.join(who, CLIENT, "left_semi")
    theirs = target.join(who, CLIENT, "left_semi")
    plan = reconcile(mine, theirs, allow_empty=True, keys=[*CLIENT, *KEYS])
    return ReconcileTick(requests, plan)


def periodic_reconcile(
    ticks: DataFrame,
    tick: Callable[[DataFrame, Column], ReconcileTick],
    checkpoint: str,
    sink: Callable[[ReconcileTick, int], None],
    interval: str | None = None,
) -> StreamingQuery:
    """Run a reconciliation per micro-batch of ``ticks`` (a stream with a ``ts`` column).

    Ticks that piled up are handled as one, at the latest time among them. Use a
    rate source for a timer.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        at = batch.agg(F.max("ts").alias("at")).first()["at"]
        if at is not None:
            sink(tick(batch, F.lit(at)), batch_id)

    return run(ticks, checkpoint, each, interval)
