"""A store of objects that takes changes as segments and merges them when it is read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.functions import documents as docs
from lockstep.operators.ordered import last_by_key
from lockstep.operators.paths import KEYS
from lockstep.streaming.state import KeyedState


@dataclass(frozen=True)
class MergeStore:
    """Objects (keys, version, doc) at ``path``, changed batch by batch; writing grows with the changes, not the store.

    ``keys`` are kind, ns and name, with account and cluster before them for the objects of several
    clients. Batches are numbered from 1; the objects that a store begins with are batch 0. A batch that is
    applied again replaces itself. Buckets are read newest row first and written whole, one by one, once they
    have more than ``compact_every`` segments.
    """

    path: str
    keys: Sequence[str] = tuple(KEYS)
    compact_every: int = 16
    buckets: int = 64

    @property
    def _state(self) -> KeyedState:
        names = ", ".join(f"{k} string" for k in self.keys)
        schema = f"{names}, version string, doc string, live boolean"
        return KeyedState(self.path, tuple(self.keys), schema, self.compact_every, self.buckets)

    def create(self, objects: DataFrame) -> None:
        """Write the first objects, one row per key."""
        rows = objects.select(*self.keys, F.col("version").cast("string").alias("version"), "doc", F.lit(True).alias("live"))
        self._state.write(objects.sparkSession, rows, 0)

    def apply(self, changes: DataFrame, batch: int, order: str = "seq", keep_metadata: bool = False) -> None:
        """Create, update and delete by key (``op`` is put or delete); of several changes to a key the last counts.

        Stored objects are read only with ``keep_metadata``, which leaves the metadata of an
        updated document in place and adds labels and annotations, and then only those that are changed.
        """
        spark = changes.sparkSession
        last = last_by_key(changes.select(*self.keys, "op", "version", "doc", order), self.keys, order)
        doc = F.col("doc")
        if keep_metadata:
            held = self.read(spark, batch - 1, last).select(*self.keys, F.col("doc").alias("_held"))
            last = last.join(held, list(self.keys), "left")
            doc = F.when(F.col("_held").isNull(), F.col("doc")).otherwise(docs.merge_metadata("_held", "doc"))
        rows = last.select(
            *self.keys, F.col("version").cast("string").alias("version"), doc.alias("doc"), (F.col("op") != "delete").alias("live")
        )
        self._state.write(spark, rows, batch)

    def read(self, spark: SparkSession, batch: int, touched: DataFrame | None = None) -> DataFrame:
        """The objects after ``batch``, only those with the keys of ``touched`` if given."""
        return self._state.before(spark, batch + 1, touched).drop("live")
