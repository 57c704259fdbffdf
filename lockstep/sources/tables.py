"""Sources and sinks: snapshots, change streams, message logs and posted objects."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lockstep.model import CHANGE_SCHEMA, INGEST_SCHEMA, LOG_SCHEMA, OBJECT_SCHEMA

CHANGE_OPS = ["Added", "Modified", "Deleted"]


def read_snapshot(
    spark: SparkSession,
    path: str,
    kind: str | None = None,
    fmt: str = "parquet",
    schema: str | None = OBJECT_SCHEMA,
) -> DataFrame:
    """All objects of a snapshot, or those of one kind; the kind filter reaches the scan."""
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df if kind is None else df.where(F.col("kind") == kind)


def read_changes(
    spark: SparkSession,
    path: str,
    stream: bool = False,
    fmt: str = "parquet",
    schema: str | None = CHANGE_SCHEMA,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A watch stream from files, as table or as stream; a restarted stream resumes from its checkpoint."""
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**(options or {}))
    return (reader.schema(schema) if schema else reader).load(path)


def usable_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Added, Modified and Deleted rows that hold an object, and the rest (errors, non-objects)."""
    usable = F.coalesce(F.col("op").isin(*CHANGE_OPS) & F.col("name").isNotNull(), F.lit(False))
    return changes.where(usable), changes.where(~usable)


def read_messages(
    spark: SparkSession,
    path: str | None = None,
    stream: bool = False,
    kafka: Mapping[str, str] | None = None,
    fmt: str = "parquet",
    schema: str | None = LOG_SCHEMA,
) -> DataFrame:
    """The message log: key, properties, payload, ts, and its place by partition and offset.

    The place is null where the log does not keep it. With ``kafka`` options the log is read from its latest position; headers
    become properties.
    """
    if kafka is not None:
        reader = (spark.readStream if stream else spark.read).format("kafka")
        start = "latest" if stream else "earliest"
        raw = reader.options(startingOffsets=start, includeHeaders="true", **kafka).load()
        properties = F.map_from_entries(
            F.transform("headers", lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")))
        )
        return raw.select(
            F.col("key").cast("string").alias("key"),
            properties.alias("properties"),
            F.col("value").cast("string").alias("payload"),
            F.col("timestamp").alias("ts"),
            "partition",
            "offset",
        )
    reader = (spark.readStream if stream else spark.read).format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def with_properties(log: DataFrame) -> DataFrame:
    """Log rows with the routing properties as columns; the payload stays undecoded."""
    return log.select(
        F.col("key").alias("producer_key"),
        *[F.col("properties")[p].alias(p) for p in ("event", "account", "cluster")],
        "properties",
        "payload",
        "ts",
        *[c for c in ("partition", "offset") if c in log.columns],
    )


def read_ingest(
    spark: SparkSession, path: str, stream: bool = False, fmt: str = "json", schema: str | None = INGEST_SCHEMA
) -> DataFrame:
    """Posted objects: method, path, body."""
    reader = (spark.readStream if stream else spark.read).format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A snapshot, partitioned by kind, at a new path; files are written once and never merged."""
    df.write.format(fmt).partitionBy("kind").mode("errorifexists").save(path)


def write_store(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """A store as bucketed table, so that joins on the object key do not shuffle it again.

    Choose ``buckets`` so that one bucket fits a task; every operator that joins
    with the store then moves only its other side.
    """
    keys = ["kind", "ns", "name"]
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("errorifexists").saveAsTable(table)


def read_store(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def as_kafka(log: DataFrame) -> DataFrame:
    """Envelopes in the columns of a Kafka sink; properties become headers."""
    headers = F.transform(
        F.map_entries("properties"),
        lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")),
    )
    return log.select("key", F.col("payload").alias("value"), headers.alias("headers"))


def write_messages(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Envelopes appended to the message log."""
    df.write.format(fmt).mode("append").save(path)


def stream_messages(
    df: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    available_now: bool = True,
    options: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Envelopes of a stream written to the message log, exactly once per checkpoint for file targets."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.options(**(options or {}))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(path)
