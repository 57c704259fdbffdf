"""Store operators over seven clients that share the names of their objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.cluster import lookup
from lockstep.functions import documents as docs
from lockstep.model import KINDS_SCHEMA
from lockstep.operators import store as st
from lockstep.operators.paths import CLIENT, KEYS
from lockstep.plans import exchange as ex
from workload.base import KINDS, KINDS_SQL, derived, kinds, query, with_inputs

# Every seventh order in a row belongs to the same client; their names are alike.
OWNED = "SELECT 'a' AS account, concat('c', CAST(name AS BIGINT) % 7) AS cluster, kind, ns, CAST(CAST(name AS BIGINT) // 7 AS VARCHAR) AS name, version, doc FROM"
SIDES = with_inputs("source", "target") + f", s AS ({OWNED} source), t AS ({OWNED} target)\n"
ON = " AND ".join(f"s.{k} = t.{k}" for k in [*CLIENT, *KEYS])
ID = ", ".join(f"coalesce(s.{k}, t.{k}) AS {k}" for k in [*CLIENT, *KEYS])


def owned(spark, sf_dir, name):
    """A snapshot dealt to clients."""
    number = F.col("name").cast("bigint")
    return derived(spark, sf_dir, name).withColumns(
        {"account": F.lit("a"), "cluster": F.concat(F.lit("c"), number % 7), "name": F.floor(number / 7).cast("string")}
    )


@query(
    "verify_by_client",
    SIDES
    + f"""SELECT {ID}, CASE WHEN t.doc IS NULL THEN 'missing' ELSE 'mismatch' END AS reason, t.doc AS base_object
    FROM s LEFT JOIN t ON {ON} WHERE t.doc IS NULL OR sha256(s.doc) <> sha256(t.doc)""",
)
def verify_by_client(spark, sf_dir):
    asked = owned(spark, sf_dir, "source").select(*CLIENT, *KEYS, docs.checksum("doc").alias("checksum"))
    return st.verify(asked, owned(spark, sf_dir, "target")).select(*CLIENT, *KEYS, "reason", "base_object")


NEWER = "t.name IS NULL OR s.version > t.version"


@query(
    "save_if_newer_by_client",
    SIDES
    + f"""SELECT {ID}, CASE WHEN {NEWER} THEN s.version ELSE t.version END AS version,
           sha256(CASE WHEN {NEWER} THEN s.doc ELSE t.doc END) AS digest
    FROM s FULL OUTER JOIN t ON {ON}""",
)
def save_if_newer_by_client(spark, sf_dir):
    after = st.save_if_newer(owned(spark, sf_dir, "target"), owned(spark, sf_dir, "source"))
    return after.select(*CLIENT, *KEYS, "version", F.sha2("doc", 256).alias("digest"))


@query(
    "apply_changes_by_client",
    SIDES
    + f"""SELECT {ID}, coalesce(s.version, t.version) AS version, sha256(coalesce(s.doc, t.doc)) AS digest
    FROM s FULL OUTER JOIN t ON {ON} WHERE coalesce(s.ns, '') <> 'P'""",
)
def apply_changes_by_client(spark, sf_dir):
    op = F.when(F.col("ns") == "P", "delete").otherwise("put")
    changes = owned(spark, sf_dir, "source").withColumns({"op": op, "seq": F.lit(1)})
    after = st.apply_changes(owned(spark, sf_dir, "target"), changes)
    return after.select(*CLIENT, *KEYS, "version", F.sha2("doc", 256).alias("digest"))


@query(
    "resolve_conflicts_by_client",
    SIDES
    + """, both_sides AS (SELECT *, 'cluster' AS origin, 0 AS o FROM s UNION ALL SELECT *, 'backend', 1 FROM t)
    SELECT account, cluster, kind, ns, name, version, origin FROM both_sides
    QUALIFY row_number() OVER (PARTITION BY account, cluster, kind, ns, name ORDER BY version DESC, o DESC) = 1""",
)
def resolve_conflicts_by_client(spark, sf_dir):
    won = st.resolve_conflicts(owned(spark, sf_dir, "source"), owned(spark, sf_dir, "target"))
    return won.select(*CLIENT, *KEYS, "version", "origin")


@query(
    "serve_gets_by_client",
    SIDES
    + f""", {KINDS_SQL}
    SELECT t.account, t.cluster, t.kind, t.ns, t.name,
           CASE WHEN s.doc IS NULL THEN 'error' WHEN k.strategy IS DISTINCT FROM 'patch' THEN 'PutObject' ELSE 'PatchObject' END AS event,
           CASE WHEN s.doc IS NULL THEN NULL WHEN k.strategy IS DISTINCT FROM 'patch' THEN s.doc WHEN t.doc = s.doc THEN '{{}}'
                ELSE concat('{{"spec":{{"customer":', json_extract(s.doc, '$.spec.customer'), '}}}}') END AS body
    FROM t LEFT JOIN s ON {ON} LEFT JOIN kinds k ON k.kind = t.kind
    WHERE NOT (s.doc IS NOT NULL AND t.kind = 'shop/v1/urgent')""",
)
def serve_gets_by_client(spark, sf_dir):
    """Every object of the target is asked for, and the other side is known to hold it; a version alone is no patch."""
    target = owned(spark, sf_dir, "target")
    answers, errors = st.serve_gets(target.select(*CLIENT, *KEYS), owned(spark, sf_dir, "source"), target, kinds(spark))
    none = F.lit(None).cast("string")
    return answers.select(*CLIENT, *KEYS, "event", F.coalesce("patch", "object").alias("body")).unionByName(
        errors.select(*CLIENT, *KEYS, F.lit("error").alias("event"), none.alias("body"))
    )


@query("exchange", SIDES + "SELECT account, cluster, kind, ns, name, version, sha256(doc) AS digest, 'stored' AS flow FROM s")
def exchange(spark, sf_dir):
    """Two differing stores of several clients, verified object by object, until they are equal and nothing is left to say."""
    # urgent orders differ by version alone, which is not worth a patch
    strategies = [(k, "copy" if k == "shop/v1/urgent" else how) for k, how in KINDS]
    strategies = lookup(spark, strategies, KINDS_SCHEMA)
    source, target = (ex.StoreSide(owned(spark, sf_dir, side), strategies) for side in ("source", "target"))
    done = ex.exchange(target, source, ex.opening(source.store, target.store))
    stored = target.store.select(*CLIENT, *KEYS, "version", F.sha2("doc", 256).alias("digest"), F.lit("stored").alias("flow"))
    left = done.left.select(*CLIENT, *KEYS, F.col("version").cast("bigint").alias("version"), F.col("checksum").alias("digest"), F.lit("left").alias("flow"))
    return stored.unionByName(left)
