"""Session helpers: where lineage is cut, and how lookup lists become tables."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup list handed in by the caller is broadcast up to this many rows.
# Longer lists become an ordinary table and Spark chooses the join.
MAX_LOOKUP_ROWS = 10_000

# Documents that a task takes at a time where heavy work follows a join.
ROWS_PER_TASK = 20_000


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A configuration list of texts as a table, broadcast only while its size allows."""
    names = [field.split()[0] for field in schema.split(",")]
    columns = list(zip(*rows)) or [[] for _ in names]
    arrow = pa.table([pa.array(list(c), pa.string()) for c in columns], names=names)
    table = spark.createDataFrame(arrow)
    return F.broadcast(table) if len(rows) <= MAX_LOOKUP_ROWS else table


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the files give fewer splits than there are cores.

    For work that is heavy per row, on a table as it was read: asking a joined or
    aggregated one for its partitions would run it. Large inputs come in enough
    splits and pass through.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The ``rows`` rows of a table as it was read, dealt by ``keys`` into tasks of ``ROWS_PER_TASK`` rows.

    Spark sizes tasks by bytes after compression, which says little about the work and memory that
    documents take. Joins by the keys keep the tasks as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // ROWS_PER_TASK)), *keys)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the session names it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lockstep-"))
        return spark.conf.get("spark.checkpoint.dir")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def checked_broadcast(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Materialise a derived side of a join and broadcast it when it turned out small.

    Spark estimates a derived table by its input, so without the check a handful
    of rows per kind would still shuffle the large side.
    """
    table = cut(df)
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table
