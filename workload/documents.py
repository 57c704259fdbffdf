"""Documents as path rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.functions import documents as docs
from lockstep.operators import paths
from lockstep.operators.paths import KEYS
from workload.base import by_key, derived, query, table, with_inputs

OLD_ROWS = """
SELECT CAST(p_partkey AS VARCHAR) AS name, '/kind' AS path, '"Part"' AS value FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/metadata/labels/brand', concat('"', p_brand, '"') FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/metadata/labels/type', concat('"', p_type, '"') FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/metadata/name', concat('"', p_partkey, '"') FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/metadata/resourceVersion', '"1"' FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/spec/cents', CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/spec/size', CAST(p_size AS VARCHAR) FROM part
"""

NEW_ROWS = """
SELECT CAST(p_partkey AS VARCHAR) AS name, '/kind' AS path, '"Part"' AS value FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/metadata/labels/brand', concat('"', p_brand, '"') FROM part WHERE p_type <> 'LARGE'
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/metadata/labels/type', concat('"', p_type, '"') FROM part WHERE p_type NOT IN ('LARGE', 'SMALL')
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/metadata/name', concat('"', p_partkey, '"') FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/metadata/resourceVersion', CASE WHEN p_size > 20 THEN '"2"' ELSE '"1"' END FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/spec/cents',
                 CAST(CAST(round(p_retailprice * 100) AS BIGINT) + CASE WHEN p_type = 'PROMO' THEN 100 ELSE 0 END AS VARCHAR) FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/spec/size', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 5
"""

DIFF_ROWS = """
SELECT CAST(p_partkey AS VARCHAR) AS name, '/metadata/resourceVersion' AS path, 'set' AS op, '"2"' AS value FROM part WHERE p_size > 20
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/metadata/labels', 'delete', NULL FROM part WHERE p_type = 'LARGE'
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/metadata/labels/type', 'delete', NULL FROM part WHERE p_type = 'SMALL'
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/spec/size', 'delete', NULL FROM part WHERE p_size <= 5
UNION ALL SELECT CAST(p_partkey AS VARCHAR), '/spec/cents', 'set', CAST(CAST(round(p_retailprice * 100) AS BIGINT) + 100 AS VARCHAR)
          FROM part WHERE p_type = 'PROMO'
"""


@query("path_rows", OLD_ROWS)
def path_rows(spark, sf_dir):
    return paths.to_path_rows(derived(spark, sf_dir, "old_parts")).drop("kind", "ns")


@query("typed_path_rows", "SELECT p_partkey, '/' || path AS path, value FROM (SELECT p_partkey, unnest([{'path': 'name', 'value': concat('\"', p_name, '\"')}, {'path': 'size', 'value': CAST(p_size AS VARCHAR)}], recursive := true) FROM part)")
def typed_path_rows(spark, sf_dir):
    tree = docs.struct_leaves({"/name": "concat('\"', p_name, '\"')", "/size": "cast(p_size AS STRING)"})
    return paths.explode_leaves(table(spark, sf_dir, "part").withColumn("leaves", tree), ["p_partkey"])


@query("diff_rows", DIFF_ROWS)
def diff_rows(spark, sf_dir):
    old, new = derived(spark, sf_dir, "old_parts"), derived(spark, sf_dir, "new_parts")
    return paths.diff_rows(old, new).drop("kind", "ns")


@query("patch_rows", NEW_ROWS)
def patch_rows(spark, sf_dir):
    old, new = derived(spark, sf_dir, "old_parts"), derived(spark, sf_dir, "new_parts")
    change = paths.diff_documents(old, new)
    patches = change.select(*KEYS, docs.leaves_to_json("change").alias("patch"))
    return paths.patch_rows(old, patches).drop("kind", "ns")


@query(
    "rows_checksum",
    with_inputs("new_parts") + "SELECT name, sha256(doc) AS checksum FROM new_parts",
)
def rows_checksum(spark, sf_dir):
    rows = paths.to_path_rows(derived(spark, sf_dir, "new_parts"))
    return paths.rows_checksum(rows).select("name", "checksum")


@query("change_report", f"SELECT path, op, count(*) AS n_objects FROM ({DIFF_ROWS}) d GROUP BY path, op")
def change_report(spark, sf_dir):
    old, new = derived(spark, sf_dir, "old_parts"), derived(spark, sf_dir, "new_parts")
    return paths.change_report(old, new)


@query(
    "long_documents",
    "SELECT doc_id, sha256(text) AS digest, strlen(text) AS bytes FROM documents",
)
def long_documents(spark, sf_dir):
    """Whole texts through leaves and back; the text must survive unchanged."""
    doc = F.to_json(F.struct("source", F.struct("text", "lang").alias("body")))
    rows = table(spark, sf_dir, "documents").select("doc_id", doc.alias("doc"))
    back = rows.withColumn("tree", docs.leaves("doc")).withColumn("back", docs.leaves_to_json("tree"))
    text = F.get_json_object("back", "$.body.text")
    return back.select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))


DEEP = """
SELECT 'shop/v1/parts' AS kind, 'stock' AS ns, CAST(p_partkey AS STRING) AS name,
       CONCAT(REPEAT('{{"n":', CAST(1 + p_partkey % 40 AS INT)), CAST(p_size + {raised} AS STRING),
              REPEAT('}}', CAST(1 + p_partkey % 40 AS INT))) AS doc
FROM {{part}}
"""


@query(
    "deep_documents",
    """
    WITH p AS (SELECT p_partkey, CAST(1 + p_partkey % 40 AS INT) AS k, p_size,
                      p_size + CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS after FROM part),
    d AS (SELECT *, concat(repeat('{"n":', k), CAST(after AS VARCHAR), repeat('}', k)) AS doc FROM p)
    SELECT CAST(p_partkey AS VARCHAR) AS name, repeat('/n', k) AS path, CAST(after AS VARCHAR) AS value,
           CASE WHEN after <> p_size THEN doc END AS patch, sha256(doc) AS checksum
    FROM d
    """,
)
def deep_documents(spark, sf_dir):
    """Documents of 1 to 40 nested objects through diff, patch, leaves and checksum."""
    part = table(spark, sf_dir, "part")
    raised = "CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END"
    old, new = (spark.sql(DEEP.replace("{raised}", r).replace("{{part}}", "{part}"), part=part) for r in ("0", raised))
    old, new = (by_key(spark, sf_dir, side, "part") for side in (old, new))
    change = paths.diff_documents(old, new).select(*KEYS, docs.leaves_to_json("change").alias("patch"))
    # the outer join lets go of how its sides were dealt
    change = by_key(spark, sf_dir, change, "part")
    rows = paths.patch_rows(old, change)
    sums = paths.rows_checksum(rows)
    return rows.join(sums, KEYS).join(change, KEYS).select("name", "path", "value", "patch", "checksum")
