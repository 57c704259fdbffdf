"""Keyed tables in shared storage that are changed without being rewritten."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.operators.ordered import last_by_key


@dataclass(frozen=True)
class KeyedState:
    """The newest row per key, kept as segments of changes in buckets of keys.

    Version ``n`` writes a segment with the keys it touched, dealt into ``buckets`` by a hash of
    the key, and a list of the segments that each bucket is read from. A bucket that would be read from more than
    ``compact_every`` segments is written whole instead, alone; all others are left as
    they are, so what is written grows with the changes. Reading takes the newest row of each key, only
    of the buckets asked for. A repeated version reads and overwrites the same folders, so a
    restart gives the same table. Rows with ``live`` false mark removed keys; they vanish when
    their bucket is written whole.
    """

    path: str
    keys: Sequence[str]
    schema: str
    compact_every: int = 16
    buckets: int = 64
    #: Tasks that a bucket is written by, at most; each of them writes a file of it.
    writers: int = 4
    #: Versions of which the segments are kept though a later one is whole; a query may restart from them.
    keep_versions: int = field(default=100)

    def _segment(self, version: int, bucket: int | None = None) -> str:
        return f"{self.path}/segments/version={version}" + (f"/bucket={bucket}" if bucket is not None else "")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _listed(self, spark: SparkSession, version: int) -> dict[int, list[int]]:
        """The segments of each bucket, oldest first, as of the end of ``version``: at most buckets x compact_every numbers."""
        if version < 0:
            return {}
        rows = spark.read.schema("bucket int, segments array<bigint>").parquet(f"{self.path}/versions/version={version}")
        return {r["bucket"]: list(r["segments"]) for r in rows.collect()}

    def _read(self, spark: SparkSession, listed: dict[int, list[int]]) -> DataFrame:
        """All rows of the segments listed, with ``_version``."""
        by_version: dict[int, list[int]] = {}
        for bucket, versions in listed.items():
            for version in versions:
                by_version.setdefault(version, []).append(bucket)
        out = None
        for version, buckets in sorted(by_version.items()):
            paths = [self._segment(version, b) for b in buckets]
            part = spark.read.schema(self.schema).parquet(*paths).withColumn("_version", F.lit(version).cast("bigint"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = spark.createDataFrame([], self.schema).withColumn("_version", F.lit(0).cast("bigint"))
        return out

    def before(self, spark: SparkSession, version: int, touched: DataFrame | None = None) -> DataFrame:
        """The live rows as they were when ``version`` began, only of the keys in ``touched`` if given.

        Of those only the buckets they fall into are read, and the keys are picked before
        anything is aggregated, so only their rows are shuffled.
        """
        listed = self._listed(spark, version - 1)
        if touched is not None:
            wanted = {r["b"] for r in touched.select(self._bucket().alias("b")).distinct().collect()}  # at most ``buckets``
            listed = {b: s for b, s in listed.items() if b in wanted}
        rows = self._read(spark, listed)
        if touched is not None:
            rows = rows.join(touched.select(*self.keys).distinct(), list(self.keys), "left_semi")
        if max(map(len, listed.values()), default=0) > 1:
            rows = last_by_key(rows, self.keys, "_version")
        return rows.where("live").drop("_version")

    def write(self, spark: SparkSession, touched: DataFrame, version: int) -> None:
        """Make ``touched``, one row per key, the newest rows; ``version`` follows the last one."""
        listed = self._listed(spark, version - 1)
        columns = spark.createDataFrame([], self.schema).columns
        rows = touched.select(*columns).withColumn("bucket", self._bucket()).persist()
        try:
            here = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most ``buckets``
            full = {b for b in here if len(listed.get(b, [])) >= self.compact_every}
            out = rows
            if full:
                older = self._read(spark, {b: listed[b] for b in full}).withColumn("bucket", self._bucket())
                newest = older.unionByName(rows.where(F.col("bucket").isin(sorted(full))).withColumn("_version", F.lit(version).cast("bigint")))
                whole = last_by_key(newest, [*self.keys, "bucket"], "_version").drop("_version").where("live")
                out = rows.where(~F.col("bucket").isin(sorted(full))).unionByName(whole.select(*out.columns))
            # one task may write several buckets, and a large bucket may be written by several tasks, but not by all
            dealt = out.repartition("bucket", F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(self.writers)))
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(self._segment(version))
            self._fill(spark, version, full, columns)
            after = {b: s for b, s in listed.items() if b not in here}
            after |= {b: [version] if b in full else [*listed.get(b, []), version] for b in here}
            table = spark.createDataFrame([(b, s) for b, s in sorted(after.items())], "bucket int, segments array<bigint>")
            table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")
        finally:
            rows.unpersist()
        self._remove_old(spark, version)

    def _files(self, spark: SparkSession, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _fill(self, spark: SparkSession, version: int, full: set[int], columns: list[str]) -> None:
        """A bucket of which all keys were removed has no row left to make its folder."""
        for bucket in full:
            where, files = self._files(spark, self._segment(version, bucket))
            if not files.exists(where):
                spark.createDataFrame([], self.schema).select(*columns).coalesce(1).write.mode("overwrite").parquet(
                    self._segment(version, bucket)
                )

    def _remove_old(self, spark: SparkSession, version: int) -> None:
        """Every ``keep_versions`` versions, remove the segments and lists that no version kept reads from."""
        first = version - self.keep_versions
        if first < 0 or version % self.keep_versions:
            return
        used = {(s, b) for b, segments in self._listed(spark, first).items() for s in segments}
        for kind in ("segments", "versions"):
            where, files = self._files(spark, f"{self.path}/{kind}")
            for folder in files.listStatus(where):
                number = int(folder.getPath().getName().split("=")[1])
                if number >= first:
                    continue
                if kind == "versions":
                    files.delete(folder.getPath(), True)
                    continue
                for inner in files.listStatus(folder.getPath()):
                    name = inner.getPath().getName()
                    if name.startswith("bucket=") and (number, int(name.split("=")[1])) not in used:
                        files.delete(inner.getPath(), True)

    def after(self, spark: SparkSession, version: int) -> DataFrame:
        return self.before(spark, version + 1)
