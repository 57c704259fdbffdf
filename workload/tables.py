"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.cluster import checkpoint_dir
from lockstep.operators import messages as msg
from lockstep.operators.changes import bootstrap
from lockstep.operators.store import apply_changes
from lockstep.sources.merge_store import MergeStore
from lockstep.sources import tables as io
from workload.base import ORACLES, derived, query, table, with_inputs


def scratch(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    from uuid import uuid4

    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


@query(
    "snapshot_scan",
    with_inputs("objects") + "SELECT ns, name, version, sha256(doc) AS digest FROM objects WHERE kind = 'shop/v1/urgent'",
)
def snapshot_scan(spark, sf_dir):
    path = scratch(spark, "snapshot")
    io.write_snapshot(derived(spark, sf_dir, "objects").withColumn("version", F.col("version").cast("string")), path)
    rows = io.read_snapshot(spark, path, "shop/v1/urgent")
    return rows.select("ns", "name", F.col("version").cast("bigint"), F.sha2("doc", 256).alias("digest"))


@query(
    "change_scan",
    """
    SELECT CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'usable' END AS flow, op, count(*) AS n,
           sum(event_id) AS sum_id
    FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'Added' WHEN 'purchase' THEN 'Deleted'
                                    WHEN 'error' THEN 'Error' ELSE 'Modified' END AS op FROM events) e
    GROUP BY ALL
    """,
)
def change_scan(spark, sf_dir):
    op = (
        F.when(F.col("event_type") == "signup", "Added")
        .when(F.col("event_type") == "purchase", "Deleted")
        .when(F.col("event_type") == "error", "Error")
        .otherwise("Modified")
    )
    raw = io.read_changes(spark, f"{sf_dir}/events.parquet", schema=None)
    usable, rejected = io.usable_changes(raw.withColumns({"op": op, "name": F.col("user_id").cast("string")}))
    flows = usable.withColumn("flow", F.lit("usable")).unionByName(rejected.withColumn("flow", F.lit("rejected")))
    return flows.groupBy("flow", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("sum_id"))


@query(
    "bootstrap_ops",
    with_inputs("source", "target")
    + """
    , resume AS (SELECT kind, max(version) AS top FROM target GROUP BY kind)
    SELECT kind, ns, name, version, 'VerifyObject' AS op, sha256(doc) AS checksum FROM target
    UNION ALL
    SELECT s.kind, s.ns, s.name, s.version, 'Modified', NULL
    FROM source s LEFT JOIN resume r ON s.kind = r.kind WHERE s.version > coalesce(r.top, -1)
    """,
)
def bootstrap_ops(spark, sf_dir):
    changes = derived(spark, sf_dir, "source").drop("doc").withColumn("op", F.lit("Modified"))
    return bootstrap(derived(spark, sf_dir, "target"), changes)


@query(
    "bootstrap_annotated",
    with_inputs("source", "target")
    + """
    , resume AS (SELECT kind, max(version) AS top FROM target GROUP BY kind)
    SELECT kind, ns, name, CAST(version AS VARCHAR) AS version, 'VerifyObject' AS op,
           CASE WHEN ns = 'O' THEN concat('known-', name) ELSE sha256(doc) END AS checksum
    FROM target
    UNION ALL
    SELECT s.kind, s.ns, s.name, CASE WHEN s.ns = 'P' THEN 'v' ELSE '' END || CAST(s.version AS VARCHAR), 'Modified', NULL
    FROM source s LEFT JOIN resume r ON s.kind = r.kind WHERE s.ns = 'P' OR s.version > coalesce(r.top, -1)
    """,
)
def bootstrap_annotated(spark, sf_dir):
    """Open orders carry a checksum of their own; pending ones change under versions that are no numbers."""
    given = F.concat(F.lit('"metadata":{"annotations":{"sync/sum":"known-'), "name", F.lit('"},'))
    doc = F.when(F.col("ns") == "O", F.replace("doc", F.lit('"metadata":{'), given)).otherwise(F.col("doc"))
    target = derived(spark, sf_dir, "target").withColumns({"doc": doc, "version": F.col("version").cast("string")})
    version = F.concat(F.when(F.col("ns") == "P", "v").otherwise(""), F.col("version").cast("string"))
    changes = derived(spark, sf_dir, "source").drop("doc").withColumns({"op": F.lit("Modified"), "version": version})
    return bootstrap(target, changes, "sync/sum")


@query(
    "message_scan",
    with_inputs("messages")
    + """
    SELECT account, cluster, event, count(*) AS n, sum(strlen(payload)) AS payload_bytes
    FROM messages GROUP BY ALL
    """,
)
def message_scan(spark, sf_dir):
    path = scratch(spark, "log")
    rows = derived(spark, sf_dir, "messages")
    io.write_messages(msg.envelope(rows, "own", payload=F.col("payload")).withColumn("ts", F.col("ts").cast("timestamp")), path)
    log = io.with_properties(io.read_messages(spark, path))
    return log.groupBy("account", "cluster", "event").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("payload_bytes")
    )


@query(
    "message_envelope",
    with_inputs("messages")
    + """
    SELECT 'own' AS key,
           account, cluster, event, 'shop' AS "group", 'v1' AS version, split_part(kind, '/', 3) AS resource,
           name, ns AS namespace, '0' AS "resourceVersion",
           concat('{"account":"', account, '","cluster":"', cluster, '","depth":', depth, ',"kind":"', kind,
                  '","msgId":"', msg_id, '","name":"', name, '","namespace":"', ns, '","resourceVersion":0',
                  CASE WHEN event IN ('VerifyObject', 'PatchObject', 'PutObject')
                       THEN concat(',"checksum":"', sha256(payload), '"') ELSE '' END,
                  CASE WHEN event = 'GetObject' THEN concat(',"baseObject":"', base64(encode(payload)), '"') ELSE '' END,
                  CASE WHEN event IN ('PatchObject', 'PutObject')
                       THEN concat(',"patch":"', base64(encode(payload)), '"') ELSE '' END, '}') AS payload
    FROM messages
    """,
)
def message_envelope(spark, sf_dir):
    payload = F.col("payload")
    rows = derived(spark, sf_dir, "messages", heavy=True).withColumns(
        {"checksum": F.sha2(payload, 256), "object": payload, "patch": payload, "base_object": payload}
    )
    names = [
        "account",
        "cluster",
        "event",
        "group",
        "version",
        "resource",
        "name",
        "namespace",
        "resourceVersion",
    ]
    log = msg.envelope(rows, "own")
    return log.select("key", *[F.col("properties")[n].alias(n) for n in names], "payload")


@query(
    "apply_changes",
    with_inputs("source", "target")
    + """
    , change AS (
      SELECT kind, ns, name, version, doc, CASE WHEN ns = 'P' THEN 'delete' ELSE 'put' END AS op FROM source)
    SELECT coalesce(c.kind, t.kind) AS kind, coalesce(c.ns, t.ns) AS ns, coalesce(c.name, t.name) AS name,
           CASE WHEN c.op IS NULL THEN t.version ELSE c.version END AS version,
           sha256(CASE WHEN c.op IS NULL THEN t.doc ELSE c.doc END) AS digest
    FROM target t FULL OUTER JOIN change c ON t.kind = c.kind AND t.ns = c.ns AND t.name = c.name
    WHERE c.op IS DISTINCT FROM 'delete'
    """,
)
def apply_changes_query(spark, sf_dir):
    after = apply_changes(derived(spark, sf_dir, "target"), source_changes(spark, sf_dir))
    return after.select("kind", "ns", "name", "version", F.sha2("doc", 256).alias("digest"))


def source_changes(spark, sf_dir):
    source = derived(spark, sf_dir, "source")
    op = F.when(F.col("ns") == "P", "delete").otherwise("put")
    # every change arrives after an older one to the same key, which must not count
    older = source.withColumns({"op": F.lit("put"), "seq": F.lit(0), "version": F.lit(-1).cast("bigint")})
    return source.withColumns({"op": op, "seq": F.lit(1)}).unionByName(older)


@query("merge_store", ORACLES["apply_changes"])
def merge_store(spark, sf_dir):
    """The same changes in batches by kind, the older ones first, into a store that is never rewritten as a whole."""
    changes = source_changes(spark, sf_dir)
    store = MergeStore(scratch(spark, "store"), compact_every=2, buckets=8)
    store.create(derived(spark, sf_dir, "target"))
    urgent = F.col("kind").isin("shop/v1/urgent", "shop/v1/high")
    batches = [F.col("seq") == 0, (F.col("seq") == 1) & urgent, (F.col("seq") == 1) & ~urgent]
    for number, wanted in enumerate(batches, start=1):
        store.apply(changes.where(wanted), number)
    after = store.read(spark, len(batches))
    return after.select("kind", "ns", "name", F.col("version").cast("bigint").alias("version"), F.sha2("doc", 256).alias("digest"))


@query("ingest_scan", "SELECT lang AS method, source AS path, sha256(text) AS digest FROM documents")
def ingest_scan(spark, sf_dir):
    path = scratch(spark, "posted")
    docs = table(spark, sf_dir, "documents")
    docs.select(F.col("lang").alias("method"), F.col("source").alias("path"), F.col("text").alias("body")).write.json(path)
    return io.read_ingest(spark, path).select("method", "path", F.sha2("body", 256).alias("digest"))
