"""Joins of messages, snapshots and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.functions import documents as docs
from lockstep.operators import reconcile as rec
from lockstep.operators import store as st
from lockstep.operators.clients import live_connections, route_to_connected
from lockstep.operators.paths import KEYS
from lockstep.plans.flows import sync_round, verify_round
from workload.base import KINDS_SQL, by_key, derived, kinds, query, with_inputs
from workload.ordered import CONNECTIONS_SQL, LIVE_SQL, connections

ON = "s.kind = t.kind AND s.ns = t.ns AND s.name = t.name"


@query(
    "verify_objects",
    with_inputs("source", "target")
    + f"""
    SELECT s.kind, s.ns, s.name, CASE WHEN t.doc IS NULL THEN 'missing' ELSE 'mismatch' END AS reason, t.doc AS base_object
    FROM source s LEFT JOIN target t ON {ON}
    WHERE t.doc IS NULL OR sha256(s.doc) <> sha256(t.doc)
    """,
)
def verify_objects(spark, sf_dir):
    source = derived(spark, sf_dir, "source").select(*KEYS, docs.checksum("doc").alias("checksum"))
    return st.verify(source, derived(spark, sf_dir, "target")).select(*KEYS, "reason", "base_object")


RECONCILE_SQL = f"""
SELECT coalesce(s.kind, t.kind) AS kind, coalesce(s.ns, t.ns) AS ns, coalesce(s.name, t.name) AS name,
       coalesce(s.version, -1) AS source_version, coalesce(t.version, -1) AS target_version,
       CASE WHEN s.name IS NULL THEN 'delete'
            WHEN t.name IS NULL THEN CASE WHEN s.ns <> 'P' THEN 'verify' ELSE 'skip' END
            WHEN s.version <> t.version THEN 'put' ELSE 'skip' END AS op
FROM source s FULL OUTER JOIN target t ON {ON}
"""


@query("reconcile", with_inputs("source", "target") + f"SELECT * FROM ({RECONCILE_SQL}) r WHERE op <> 'skip'")
def reconcile(spark, sf_dir):
    plan = rec.reconcile(derived(spark, sf_dir, "source"), derived(spark, sf_dir, "target"), scope=F.col("ns") != "P")
    return plan.fillna(-1, ["source_version", "target_version"])


@query(
    "reconcile_messages",
    with_inputs("source", "target")
    + f"""
    SELECT r.kind, r.ns, r.name, r.op, sha256(s.doc) AS digest FROM ({RECONCILE_SQL}) r
    LEFT JOIN source s ON s.kind = r.kind AND s.ns = r.ns AND s.name = r.name WHERE op <> 'skip'
    """,
)
def reconcile_messages(spark, sf_dir):
    source = derived(spark, sf_dir, "source")
    plan = rec.reconcile(source, derived(spark, sf_dir, "target"), scope=F.col("ns") != "P")
    return rec.with_documents(plan, source).select(*KEYS, "op", docs.checksum("doc").alias("digest"))


@query(
    "route_connected",
    with_inputs("messages")
    + f", {CONNECTIONS_SQL}, {LIVE_SQL}"
    + """
    SELECT seq, event FROM messages m
    WHERE EXISTS (SELECT 1 FROM live l WHERE l.account = m.account AND l.cluster = m.cluster)
    """,
)
def route_connected(spark, sf_dir):
    live = live_connections(connections(spark, sf_dir))
    return route_to_connected(derived(spark, sf_dir, "messages"), live).select("seq", "event")


@query(
    "put_or_patch",
    with_inputs("old_parts", "new_parts", "part_patch", "objects")
    + """
    SELECT 'shop/v1/parts' AS kind, name, 'PatchObject' AS event, patch AS body, sha256(new_doc) AS checksum
    FROM part_patch WHERE edits <> '{"metadata":{"resourceVersion":"2"}}'
    UNION ALL
    SELECT kind, name, 'PutObject', doc, sha256(doc) FROM objects
    """,
)
def put_or_patch(spark, sf_dir):
    new = derived(spark, sf_dir, "new_parts")
    fresh = derived(spark, sf_dir, "objects").withColumn("version", F.col("version").cast("string"))
    sent = st.put_or_patch(new.unionByName(fresh), derived(spark, sf_dir, "old_parts"), kinds(spark))
    return sent.select("kind", "name", "event", F.coalesce("patch", "object").alias("body"), "checksum")


PATCH_MESSAGES = """
SELECT 'shop/v1/parts' AS kind, 'stock' AS ns, name,
       CASE WHEN ends_with(name, '7') THEN 'off' ELSE sha256(new_doc) END AS checksum, patch
FROM part_patch
"""


def patch_messages(spark, sf_dir):
    """A patch per part; the announced checksum is wrong for some."""
    new, old = (by_key(spark, sf_dir, derived(spark, sf_dir, side, heavy=False), "part") for side in ("new_parts", "old_parts"))
    sent = st.encode_changes(
        new.join(old.select(*KEYS, F.col("doc").alias("base")), KEYS),
        "base",
        "'patch'",
    )
    wrong = F.when(F.endswith("name", F.lit("7")), F.lit("off")).otherwise(F.col("checksum"))
    return sent.withColumn("checksum", wrong).drop("base", "object", "event", "version")


@query(
    "apply_patches",
    with_inputs("old_parts", "new_parts", "part_patch")
    + f", sent AS ({PATCH_MESSAGES})"
    + """
    SELECT s.name, CASE WHEN s.checksum = 'off' OR p.edits IS NULL OR o.name IS NULL THEN 'get' ELSE 'stored' END AS outcome,
           CASE WHEN s.checksum <> 'off' AND o.name IS NOT NULL THEN p.new_doc END AS doc,
           CASE WHEN s.checksum = 'off' THEN o.doc END AS base_object
    FROM sent s JOIN part_patch p ON s.name = p.name
    LEFT JOIN (SELECT * FROM old_parts WHERE CAST(json_extract_string(doc, '$.spec.size') AS INT) <> 7) o ON o.name = s.name
    WHERE p.edits <> '{"metadata":{"resourceVersion":"2"}}'
    """,
)
def apply_patches(spark, sf_dir):
    """The store lacks the parts of one size, which are asked for; patches to all others are tried."""
    store = derived(spark, sf_dir, "old_parts", heavy=False).where(F.get_json_object("doc", "$.spec.size").cast("int") != 7)
    store = by_key(spark, sf_dir, store, "part")
    done = st.apply_patches(patch_messages(spark, sf_dir), store, kinds(spark))
    return done.select("name", "outcome", "doc", "base_object")


@query(
    "save_if_newer",
    with_inputs("source", "target")
    + f"""
    SELECT coalesce(s.kind, t.kind) AS kind, coalesce(s.ns, t.ns) AS ns, coalesce(s.name, t.name) AS name,
           CASE WHEN t.name IS NULL OR s.version > t.version THEN s.version ELSE t.version END AS version,
           sha256(CASE WHEN t.name IS NULL OR s.version > t.version THEN s.doc ELSE t.doc END) AS digest
    FROM source s FULL OUTER JOIN target t ON {ON}
    """,
)
def save_if_newer(spark, sf_dir):
    after = st.save_if_newer(derived(spark, sf_dir, "target"), derived(spark, sf_dir, "source"))
    return after.select(*KEYS, "version", F.sha2("doc", 256).alias("digest"))


@query(
    "serve_gets",
    with_inputs("source", "target")
    + f", {KINDS_SQL}"
    + """
    , asked AS (SELECT kind, ns, name, CASE WHEN ns = 'O' THEN doc END AS base_object FROM target)
    SELECT a.kind, a.ns, a.name,
           CASE WHEN s.doc IS NULL THEN 'error' WHEN a.base_object IS NULL OR k.strategy IS DISTINCT FROM 'patch' THEN 'PutObject'
                ELSE 'PatchObject' END AS event,
           CASE WHEN s.doc IS NULL THEN NULL WHEN a.base_object IS NULL OR k.strategy IS DISTINCT FROM 'patch' THEN s.doc
                WHEN a.base_object = s.doc THEN '{}'
                WHEN a.kind = 'shop/v1/high' THEN concat('{"spec":{"customer":', json_extract(s.doc, '$.spec.customer'), '}}')
           END AS body
    FROM asked a LEFT JOIN source s ON s.kind = a.kind AND s.ns = a.ns AND s.name = a.name
    LEFT JOIN kinds k ON k.kind = a.kind
    WHERE NOT (s.doc IS NOT NULL AND a.base_object IS NOT NULL AND a.kind = 'shop/v1/urgent')
    """,
)
def serve_gets(spark, sf_dir):
    source, target = derived(spark, sf_dir, "source"), derived(spark, sf_dir, "target")
    requests = target.select(*KEYS, F.when(F.col("ns") == "O", F.col("doc")).alias("base_object"))
    # nothing is known beforehand: an anti-join of the source with itself is empty
    known = source.join(source.select(*KEYS), KEYS, "left_anti")
    answers, errors = st.serve_gets(requests, source, known, kinds(spark))
    body = F.coalesce("patch", "object")
    return answers.select(*KEYS, "event", body.alias("body")).unionByName(
        errors.select(*KEYS, F.lit("error").alias("event"), F.lit(None).cast("string").alias("body"))
    )


@query(
    "resolve_conflicts",
    with_inputs("source", "target")
    + """
    , both_sides AS (SELECT kind, ns, name, version, 'cluster' AS origin, 0 AS o FROM source
                     UNION ALL SELECT kind, ns, name, version, 'backend', 1 FROM target)
    SELECT kind, ns, name, version, origin FROM both_sides
    QUALIFY row_number() OVER (PARTITION BY kind, ns, name ORDER BY version DESC, o DESC) = 1
    """,
)
def resolve_conflicts(spark, sf_dir):
    won = st.resolve_conflicts(derived(spark, sf_dir, "source"), derived(spark, sf_dir, "target"))
    return won.select(*KEYS, "version", "origin")


@query(
    "sync_round",
    with_inputs("source", "target")
    + f"""
    SELECT r.kind, r.ns, r.name, CASE WHEN op = 'skip' THEN t.version ELSE s.version END AS version,
           sha256(CASE WHEN op = 'skip' THEN t.doc ELSE s.doc END) AS digest
    FROM ({RECONCILE_SQL}) r
    LEFT JOIN source s ON s.kind = r.kind AND s.ns = r.ns AND s.name = r.name
    LEFT JOIN target t ON t.kind = r.kind AND t.ns = r.ns AND t.name = r.name
    WHERE op <> 'delete' AND NOT (op = 'skip' AND t.name IS NULL)
    """,
)
def sync_round_query(spark, sf_dir):
    after = sync_round(derived(spark, sf_dir, "source"), derived(spark, sf_dir, "target"), F.col("ns") != "P")
    return after.select(*KEYS, "version", F.sha2("doc", 256).alias("digest"))


@query(
    "verify_round",
    with_inputs("source", "target")
    + f"""
    SELECT coalesce(s.kind, t.kind) AS kind, coalesce(s.ns, t.ns) AS ns, coalesce(s.name, t.name) AS name,
           sha256(CASE WHEN s.kind IS NULL OR (t.kind = 'shop/v1/urgent' AND s.version <> t.version)
                       THEN t.doc ELSE s.doc END) AS digest
    FROM source s FULL OUTER JOIN target t ON {ON}
    """,
)
def verify_round_query(spark, sf_dir):
    # urgent orders differ only by version, which is not worth a patch
    after = verify_round(derived(spark, sf_dir, "source"), derived(spark, sf_dir, "target"), kinds(spark))
    return after.select(*KEYS, F.sha2("doc", 256).alias("digest"))


@query(
    "keys_only_in",
    with_inputs("source", "target")
    + """
    SELECT * FROM (SELECT kind, ns, name, 'source' AS side FROM source EXCEPT SELECT kind, ns, name, 'source' FROM target)
    UNION ALL
    SELECT * FROM (SELECT kind, ns, name, 'target' AS side FROM target EXCEPT SELECT kind, ns, name, 'target' FROM source)
    """,
)
def keys_only_in(spark, sf_dir):
    source, target = derived(spark, sf_dir, "source"), derived(spark, sf_dir, "target")
    mine = rec.keys_only_in(source, target).withColumn("side", F.lit("source"))
    return mine.unionByName(rec.keys_only_in(target, source).withColumn("side", F.lit("target")))


@query(
    "keys_common",
    with_inputs("source", "target") + "SELECT kind, ns, name FROM source INTERSECT SELECT kind, ns, name FROM target",
)
def keys_common(spark, sf_dir):
    return rec.keys_common(derived(spark, sf_dir, "source"), derived(spark, sf_dir, "target"))
