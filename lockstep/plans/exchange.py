"""Two stores that send each other messages until neither has anything left to say."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.cluster import cut
from lockstep.functions import documents as docs
from lockstep.model import DELETE_OBJECT, GET_OBJECT, PATCH_OBJECT, VERIFY_OBJECT
from lockstep.operators import store as st
from lockstep.operators.batches import unpack_batches
from lockstep.operators.paths import object_keys, store_keys, telling
from lockstep.streaming.queries import EVENTS, Handlers, handle

#: Messages that answer messages: how long a chain may get.
MAX_DEPTH = 8
#: Messages that a task takes at a time.
MESSAGES_PER_TASK = 50_000
BODY = ["version", "checksum", "patch", "object", "base_object"]


def as_messages(rows: DataFrame, keys: Sequence[str], event: Column | None = None, deeper: int = 0) -> DataFrame:
    """``rows`` with the columns of a message: event, keys, depth and BODY, null where there is none."""
    def column(name: str) -> Column:
        found = F.col(name) if name in rows.columns else F.lit(None)
        return found.cast("string").alias(name)

    depth = F.coalesce("depth", F.lit(0)) if "depth" in rows.columns else F.lit(0)
    event = F.col("event") if event is None else event
    return rows.select(event.alias("event"), *keys, (depth + deeper).cast("int").alias("depth"), *[column(c) for c in BODY])


class StoreSide:
    """One side of an exchange: a store of objects that handles messages and answers them.

    Each handler takes the messages of its event and gives back the answers, one level
    deeper; what it stores is in ``store`` afterwards. ``check`` stores only what is newer. Gets that
    found nothing are in ``errors``. At most one put, patch or delete of a key counts in a round.

    A changed store is written before it is read. Patched and put objects meet it in one join.
    """

    def __init__(self, store: DataFrame, kinds: DataFrame, check: bool = False) -> None:
        self.kinds, self.check = kinds, check
        self.errors: list[DataFrame] = []
        #: How many messages of an event come in this round, where that is known.
        self.coming: dict[str | None, int] = {}
        self._store, self._written = store, False
        self._held: list[DataFrame] = []

    @property
    def store(self) -> DataFrame:
        self.settle()
        return self._store

    def settle(self) -> None:
        """Store what was patched and put since the store was last read."""
        if self._held:
            changes, self._held = reduce(DataFrame.unionByName, self._held), []
            self._write(st.apply_changes(self._store, changes))

    def _write(self, store: DataFrame) -> None:
        self._store, self._written = cut(store), True

    @property
    def keys(self) -> list[str]:
        return object_keys(self._store)

    def _change(self, rows: DataFrame, op: str) -> None:
        version = F.get_json_object("doc", "$.metadata.resourceVersion")
        kind = self._store.schema["version"].dataType
        at = F.lit(len(self._held))
        rows = rows.select(*self.keys, version.cast(kind).alias("version"), "doc", F.lit(op).alias("op"), at.alias("seq"))
        if op == "put" and self.check:
            rows = st.last_by_key(rows, self.keys, "version")
            self._write(st.save_if_newer(self._store, rows.drop("op", "seq")))
        elif op == "delete":
            self._write(st.apply_changes(self.store, rows))
        else:
            self._held.append(rows)

    def _met(self, messages: DataFrame, event: str) -> tuple[DataFrame, DataFrame]:
        """Messages and store, dealt by key for their join: Spark sizes tasks by compressed bytes, which say little about the work."""
        rows = self.coming.get(event, 0)
        if rows <= MESSAGES_PER_TASK:
            return messages, self.store
        if not self._written:
            # constants in a store that is computed would stand in the way of its partitions
            self._write(self.store)
        least = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(least, -(-rows // MESSAGES_PER_TASK))
        by = telling(self.keys)
        return messages.repartition(tasks, *by), self.store.repartition(tasks, *by)

    def delete(self, messages: DataFrame) -> DataFrame:
        self._change(messages.withColumn("doc", F.lit(None).cast("string")), "delete")
        return messages.where(F.lit(False))

    def get(self, messages: DataFrame) -> DataFrame:
        nothing = self.store.where(F.lit(False))
        messages, store = self._met(messages, GET_OBJECT)
        answers, errors = st.serve_gets(messages, store, nothing, self.kinds)
        self.errors.append(errors)
        return as_messages(answers, self.keys, deeper=1)

    def patch(self, messages: DataFrame) -> DataFrame:
        tried = cut(st.apply_patches(*self._met(messages, PATCH_OBJECT), self.kinds))
        self._change(tried.where("outcome = 'stored'"), "put")
        return as_messages(tried.where("outcome = 'get'"), self.keys, F.lit(GET_OBJECT), 1).withColumns(
            {c: F.lit(None).cast("string") for c in ("checksum", "patch", "object")}
        )

    def put(self, messages: DataFrame) -> DataFrame:
        self._change(messages.withColumn("doc", F.col("object")), "put")
        return messages.where(F.lit(False))

    def verify(self, messages: DataFrame) -> DataFrame:
        asked = st.verify(*self._met(messages, VERIFY_OBJECT))
        return as_messages(asked, self.keys, deeper=1).withColumn("checksum", F.lit(None).cast("string"))

    def batch(self, messages: DataFrame) -> DataFrame:
        if "items" not in messages.columns:  # a table of single messages
            return messages.where(F.lit(False))
        self.coming = {}  # of messages on their own
        return handle(as_messages(unpack_batches(messages), self.keys), self)


def opening(source: DataFrame, target: DataFrame) -> DataFrame:
    """What a source says first: verify every object it has, delete those it lacks."""
    keys = store_keys(target, source)
    mine = source.select(*keys, docs.checksum("doc").alias("checksum"))
    gone = target.select(*keys).join(source.select(*keys), telling(keys), "left_anti")
    return as_messages(mine, keys, F.lit(VERIFY_OBJECT)).unionByName(as_messages(gone, keys, F.lit(DELETE_OBJECT)))


@dataclass
class Exchange:
    """How an exchange ended: messages that were too deep to be handled, and how many rounds it took."""

    left: DataFrame
    rounds: int


def exchange(receiver: Handlers, sender: Handlers, messages: DataFrame, max_depth: int = MAX_DEPTH) -> Exchange:
    """Messages to ``receiver``, its answers to ``sender``, and so on, until there are none or they are deeper than ``max_depth``.

    Both sides are :class:`Handlers`; with :class:`StoreSide` their stores hold the outcome. Each round is written before the
    next begins, so a lost executor repeats a round and not the exchange.
    """
    here, there = receiver, sender
    rounds = 0
    while True:
        messages = cut(messages)
        late = F.col("depth") > max_depth
        known = F.when(F.col("event").isin(*EVENTS), F.col("event"))
        found = messages.groupBy(late.alias("late"), known.alias("event")).agg(F.count(F.lit(1)).alias("n")).collect()
        usable = {row.event: row.n for row in found if row.late is False}
        if not usable:
            return Exchange(messages, rounds)
        if isinstance(here, StoreSide):
            here.coming = usable
        answers = handle(messages.where(~late), here, usable)
        if isinstance(here, StoreSide):
            here.settle()
        if any(row.late for row in found):
            answers = answers.unionByName(messages.where(late))
        messages, here, there, rounds = answers, there, here, rounds + 1
