"""Filters and row validation."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from lockstep.functions import documents as docs
from lockstep.operators import guards, scope
from lockstep.operators.messages import decode_socket_messages
from lockstep.operators.paths import diff_documents
from workload.base import KINDS_SQL, derived, kinds, query, table, with_inputs
from workload.projections import socket_rows


@query("namespace_filter", with_inputs("objects") + "SELECT ns, name FROM objects WHERE ns NOT IN ('P', 'kube-system')")
def namespace_filter(spark, sf_dir):
    rows = scope.namespace_filter(derived(spark, sf_dir, "objects"), exclude=["P", "kube-system"])
    return rows.select("ns", "name")


@query("namespace_include", with_inputs("objects") + "SELECT ns, name FROM objects WHERE ns IN ('P', 'O')")
def namespace_include(spark, sf_dir):
    rows = scope.namespace_filter(derived(spark, sf_dir, "objects"), include=["P", "O"], exclude=["P"])
    return rows.select("ns", "name")


# Workloads: one per line item, with or without owner and template hash.
WORKLOADS = """
SELECT CONCAT(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS name,
       CASE l_returnflag WHEN 'A' THEN 'default' WHEN 'N' THEN 'operator' ELSE 'hidden' END AS ns,
       CASE WHEN l_linenumber <= 2 THEN 'Pod' WHEN l_linenumber = 3 THEN 'Job' WHEN l_linenumber = 4 THEN 'ReplicaSet'
            ELSE 'Deployment' END AS object_kind,
       CASE WHEN l_quantity <= 10 THEN 'apps/v1' WHEN l_quantity <= 20 THEN 'batch/v1' WHEN l_quantity <= 30 THEN 'v1'
            ELSE NULL END AS owner_api,
       CASE WHEN l_linestatus = 'F' THEN 'abc' ELSE '' END AS template_hash
FROM {lineitem}
"""

OWNED_SQL = """CASE WHEN object_kind NOT IN ('Pod', 'Job', 'ReplicaSet') THEN false
    WHEN owner_api IS NOT NULL THEN owner_api IN ('apps/v1', 'batch/v1', 'batch/v1beta1')
    ELSE object_kind = 'Pod' AND template_hash <> '' END"""


def workloads(spark, sf_dir):
    rows = spark.sql(WORKLOADS, lineitem=table(spark, sf_dir, "lineitem"))
    owner = F.struct(F.col("owner_api").alias("apiVersion"), F.lit("Owner").alias("kind"))
    none = F.array().cast("array<struct<apiVersion:string,kind:string>>")
    return rows.withColumns(
        {
            "owners": F.when(F.col("owner_api").isNotNull(), F.array(owner)).otherwise(none),
            "labels": F.create_map(F.lit("pod-template-hash"), F.col("template_hash")),
        }
    )


@query(
    "owned_filter",
    f"SELECT name, object_kind FROM ({WORKLOADS.format(lineitem='lineitem')}) w WHERE NOT ({OWNED_SQL})",
)
def owned_filter(spark, sf_dir):
    return scope.owned_filter(workloads(spark, sf_dir)).select("name", "object_kind")


@query(
    "in_scope",
    f"""
    SELECT name, ns, object_kind FROM ({WORKLOADS.format(lineitem='lineitem')}) w
    WHERE CASE WHEN ns = 'operator' THEN true WHEN ns IN ('hidden', 'kube-system') THEN false ELSE NOT ({OWNED_SQL}) END
    """,
)
def in_scope(spark, sf_dir):
    rows = scope.in_scope(workloads(spark, sf_dir), "operator", exclude=["hidden", "kube-system"])
    return rows.select("name", "ns", "object_kind")


# The workloads as documents alone.
DOCUMENTS = (
    """
SELECT name, ns, CONCAT('{{"kind":"', object_kind, '","metadata":{{',
       CASE WHEN owner_api IS NULL THEN '' ELSE CONCAT('"ownerReferences":[{{"apiVersion":"', owner_api, '"}}],') END,
       '"labels":{{"pod-template-hash":"', template_hash, '"}}}}}}') AS doc
FROM ("""
    + WORKLOADS
    + ") w"
)


@query(
    "document_scope",
    f"""
    SELECT name, ns, object_kind FROM ({WORKLOADS.format(lineitem='lineitem')}) w
    WHERE CASE WHEN ns = 'operator' THEN true WHEN ns IN ('hidden', 'kube-system') THEN false ELSE NOT ({OWNED_SQL}) END
    """,
)
def document_scope(spark, sf_dir):
    """The scope filter on rows that have nothing but their document."""
    rows = spark.sql(DOCUMENTS, lineitem=table(spark, sf_dir, "lineitem"))
    return scope.in_scope(scope.with_object_fields(rows), "operator", exclude=["hidden", "kube-system"]).select(
        "name", "ns", "object_kind"
    )


@query("depth_guard", with_inputs("messages") + "SELECT seq, depth FROM messages WHERE depth <= 8")
def depth_guard(spark, sf_dir):
    return guards.depth_guard(derived(spark, sf_dir, "messages")).select("seq", "depth")


@query(
    "drop_own",
    with_inputs("messages") + "SELECT seq, producer_key FROM messages WHERE producer_key IS DISTINCT FROM 'own'",
)
def drop_own(spark, sf_dir):
    return guards.drop_own_messages(derived(spark, sf_dir, "messages"), "own").select("seq", "producer_key")


@query(
    "mute_accounts",
    with_inputs("messages")
    + """
    SELECT seq, account, event FROM messages
    WHERE NOT (event = 'PutObject' AND kind = 'shop/v1/runtimealerts' AND account IN ('a3', 'a6', 'a9'))
    """,
)
def mute_accounts(spark, sf_dir):
    rows = guards.mute_accounts(derived(spark, sf_dir, "messages"), ["a3", "a6", "a9"])
    return rows.select("seq", "account", "event")


@query(
    "size_guard",
    "SELECT doc_id FROM documents WHERE strlen(text) <= 4000 OR lang = 'fr'",
)
def size_guard(spark, sf_dir):
    event = F.when(F.col("lang") == "fr", "VerifyObject").otherwise("PutObject")
    rows = table(spark, sf_dir, "documents").withColumn("event", event)
    return guards.size_guard(rows, "4000", payload="text").select("doc_id")


@query(
    "drop_version_only",
    with_inputs("old_parts", "new_parts", "part_patch")
    + """
    SELECT name, len(edits) AS patch_length FROM part_patch
    WHERE edits <> '{"metadata":{"resourceVersion":"2"}}'
    """,
)
def drop_version_only(spark, sf_dir):
    changes = diff_documents(derived(spark, sf_dir, "old_parts"), derived(spark, sf_dir, "new_parts"))
    text = F.coalesce(docs.leaves_to_json("change"), F.lit(""))
    return guards.drop_version_only(changes).select("name", F.length(text).alias("patch_length"))


@query(
    "quarantine",
    with_inputs("messages")
    + """
    SELECT seq, 'ok' AS flow FROM messages WHERE event <> 'GetObject'
    UNION ALL SELECT seq, 'rejected' FROM messages WHERE event = 'GetObject'
    """,
)
def quarantine(spark, sf_dir):
    good, bad = guards.quarantine(decode_socket_messages(socket_rows(spark, sf_dir)))
    return good.select("seq", F.lit("ok").alias("flow")).unionByName(bad.select("seq", F.lit("rejected").alias("flow")))


@query(
    "configured_kinds",
    with_inputs("messages")
    + f", {KINDS_SQL}"
    + """
    SELECT seq, m.kind, CASE WHEN k.kind IS NULL THEN 'audit' ELSE 'kept' END AS flow
    FROM messages m LEFT JOIN kinds k ON m.kind = k.kind
    """,
)
def configured_kinds(spark, sf_dir):
    kept, audit = scope.configured_kinds(derived(spark, sf_dir, "messages"), kinds(spark))
    return kept.select("seq", "kind", F.lit("kept").alias("flow")).unionByName(
        audit.select("seq", "kind", F.lit("audit").alias("flow"))
    )


ROUTES = [("copy", "shop", "v1", "alerts"), ("patch", "shop", "v1", "carts"), ("Copy", "shop", "V9", "alerts")]

REQUESTS = """
SELECT o_orderkey,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'PUT' WHEN '2-HIGH' THEN 'GET' ELSE 'POST' END AS method,
       CASE WHEN o_totalprice < 50000 THEN '/apis/v1/shop/v1' WHEN o_totalprice < 80000 THEN '/apis/v1/shop//alerts'
            WHEN o_totalprice < 120000 THEN '/APIS/v1/Shop/v1/Carts' WHEN o_totalprice < 160000 THEN '/apis/v1/shop/V9/alerts'
            WHEN o_totalprice < 180000 THEN '/api/v1/shop/v1/alerts' ELSE '/apis/v1/shop/v1/alerts' END AS path,
       CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN NULL
            WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'no json'
            WHEN o_orderstatus = 'O' THEN '{{"apiVersion":"shop/v1","kind":"Carts"}}'
            WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN '{{"apiVersion":"shop/v1"}}'
            ELSE '{{"apiVersion":"shop/v1","kind":"Alerts"}}' END AS body
FROM {orders}
"""


@query(
    "validate_ingest",
    f"""
    WITH requests AS ({REQUESTS.format(orders='orders')}),
    parsed AS (SELECT *, lower(path) AS p,
                      CASE method WHEN 'PUT' THEN 'patch' WHEN 'POST' THEN 'copy' ELSE lower(method) END AS strategy
               FROM requests)
    SELECT o_orderkey,
           CASE WHEN NOT regexp_full_match(p, '/apis/v1/[^/]+/[^/]+/[^/]+') THEN 400
                WHEN strategy NOT IN ('copy', 'patch') THEN 405
                WHEN concat(strategy, p) NOT IN ('copy/apis/v1/shop/v1/alerts', 'patch/apis/v1/shop/v1/carts') THEN 404
                WHEN body IS NULL THEN 400
                WHEN body IN ('no json', '{{"apiVersion":"shop/v1"}}') THEN 500
                WHEN body <> concat('{{"apiVersion":"shop/v1","kind":"', CASE strategy WHEN 'copy' THEN 'Alerts' ELSE 'Carts' END, '"}}')
                THEN 400 ELSE 202 END AS status
    FROM parsed
    """,
)
def validate_ingest(spark, sf_dir):
    requests = spark.sql(REQUESTS, orders=table(spark, sf_dir, "orders", heavy=True))
    return guards.validate_ingest(requests, ROUTES).select("o_orderkey", "status")


@query(
    "validate_connections",
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' OR c_nationkey < 2 THEN 401
                           WHEN c_mktsegment = 'MACHINERY' THEN 424 ELSE 200 END AS status
    FROM customer
    """,
)
def validate_connections(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, "key").alias("access_key"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise("account").alias("account"),
        F.when(F.col("c_nationkey") >= 2, "cluster").alias("cluster"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "invalid").alias("version"),
    )
    return guards.validate_connections(rows).select("c_custkey", "status")


NOW = datetime.datetime(2000, 1, 1, tzinfo=datetime.UTC)
DUE_SQL = """
SELECT account, cluster, server FROM clients
WHERE connection_time <= TIMESTAMP '1999-12-31 23:00:00' AND sync_version IN ('v0.0.57', 'v1.2.3-rc.1')
"""


@query("reconcile_targets", with_inputs("clients") + DUE_SQL)
def reconcile_targets(spark, sf_dir):
    due = guards.reconcile_targets(derived(spark, sf_dir, "clients"), NOW, 3600)
    return due.select("account", "cluster", "server")
