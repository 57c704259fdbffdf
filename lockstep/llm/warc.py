"""A content-addressed web archive: payloads stored once, record headers kept as they are, records joined back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.cluster import checkpoint_dir
from lockstep.llm.common import text_or_empty

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
LINE = "\r\n"
HEADER_END = LINE + LINE
#: Written to every record; a fixed date keeps repeated runs byte for byte equal.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def archive(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as two tables below ``path``.

    ``payloads``: (digest, payload), each distinct payload once, by its SHA-256.
    ``records``: (page_id, record_type, digest, header), the header text of every
    record exactly as it stands in a WARC file.

    Of records with one payload of at least ``REVISIT_BYTES`` the largest page_id is the
    response and the others revisit it; among repeated rows of that id all are responses.
    Null html is empty. A null page_id is written as an empty id and never chosen while
    another is there. Payloads are reduced per task before they are shuffled, so a
    payload that a third of the pages share moves once per task.
    """
    payload = text_or_empty("html").cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", " ").alias("url"),
        F.sha2(payload, 256).alias("digest"),
        F.sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("size"),
        payload.alias("payload"),
    )
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    light = rows.drop("payload")
    best = light.groupBy("digest").agg(F.max("page_id").alias("best"))
    typed = light.join(best, "digest")
    revisit = (F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("best"))
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit(""))

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))

    header = F.concat(
        F.lit("WARC/1.1" + LINE),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), ident, F.lit(">"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        # the block of a revisit is empty
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(revisit, F.sha2(F.lit(b""), 256)).otherwise(F.col("digest")))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("best").cast("string"), F.lit(">"))),
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            ),
        ).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit(LINE),
    )
    kind = F.when(revisit, "revisit").otherwise("response")
    typed.select("page_id", kind.alias("record_type"), "digest", header.alias("header")).write.parquet(
        f"{path}/records"
    )


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): every record's bytes as a WARC file holds them; revisits have no payload."""
    return _joined(spark, path).select(
        "page_id",
        F.concat(
            F.col("header").cast("binary"),
            F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload")),
            F.lit(HEADER_END.encode()),
        ).alias("record"),
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload, record_type, refers_to, payload_digest): the full records, revisits with the payload they refer to.

    A payload whose SHA-256 isn't its address, or whose SHA-1 isn't the header's, fails the job.
    """
    digest = F.regexp_extract("header", "\nWARC-Payload-Digest: sha1:([0-9a-f]{40})\r\n", 1)
    refers = F.regexp_extract("header", "\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n", 1)
    kind = F.regexp_extract("header", "\nWARC-Type: ([a-z]+)\r\n", 1)
    verified = F.when(
        (F.sha2("payload", 256) == F.col("digest")) & (F.sha1("payload") == digest), F.col("payload")
    ).otherwise(F.raise_error(F.concat(F.lit("damaged or missing payload "), F.col("digest"))).cast("binary"))
    return _joined(spark, path).select(
        "page_id",
        "header",
        verified.alias("payload"),
        kind.alias("record_type"),
        F.nullif(refers, F.lit("")).cast("long").alias("refers_to"),
        digest.alias("payload_digest"),
    )


def _joined(spark: SparkSession, path: str) -> DataFrame:
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    return records.join(payloads, "digest", "left")


def archived_pages(pages: DataFrame) -> DataFrame:
    """One row per page, read back from an archive written to the shared folder."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid4().hex}"
    archive(pages, path)
    return reconstruct(spark, path).select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
