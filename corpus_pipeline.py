"""From raw documents to packed training sequences."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from lockstep.cluster import checkpoint_dir
from lockstep.llm import ngrams, packing, repeats, toxicity


#: Rows that go to a Python worker at a time, at most: texts are long, and both sides hold them twice.
ROWS_AT_A_TIME = 1000


def _in_small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size for Python workers, so that their memory and the executors' stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_A_TIME:
        spark.conf.set(name, str(ROWS_AT_A_TIME))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field rejects go; it is trained on the labels beside them."""
    _in_small_batches(spark)
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id."""
    _in_small_batches(spark)
    return ngrams.one_of_each_group(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once go from the texts that hold them."""
    _in_small_batches(spark)
    return repeats.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised documents, in pieces, with their places in sequences."""
    _in_small_batches(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("best-fit packing", pack),
]

#: Trained models, suffix arrays and tokenizers are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}/{number}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
