"""Registry of queries, and the derived inputs they share with their SQL twins.

The text of a derived input runs on both engines. Names in braces are tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lockstep.cluster import dealt, lookup, spread
from lockstep.model import KINDS_SCHEMA
from lockstep.operators.paths import KEYS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The authoritative side: orders as objects. Finished orders of the first year are gone from it.
SOURCE = """
SELECT CONCAT('shop/v1/', CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
              WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'other' END) AS kind,
       o_orderstatus AS ns, CAST(o_orderkey AS STRING) AS name,
       CAST(FLOOR(o_totalprice) AS BIGINT) AS version,
       CONCAT('{{"kind":"Order","metadata":{{"name":"', CAST(o_orderkey AS STRING), '","namespace":"', o_orderstatus,
              '","resourceVersion":"', CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS STRING),
              '"}},"spec":{{"customer":', CAST(o_custkey AS STRING), ',"priority":"', o_orderpriority, '"}}}}') AS doc
FROM {orders}
WHERE o_orderstatus <> 'F' OR o_orderdate >= DATE '1996-01-01'
"""

# Every order, for operators that compare nothing.
OBJECTS = SOURCE[: SOURCE.index("WHERE")]

# The replica: it has not seen the orders of the last months, is one version behind on
# urgent ones, and holds another customer under the same version for orders of high priority.
TARGET = """
SELECT CONCAT('shop/v1/', CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
              WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'other' END) AS kind,
       o_orderstatus AS ns, CAST(o_orderkey AS STRING) AS name,
       CAST(FLOOR(o_totalprice) AS BIGINT) - CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS version,
       CONCAT('{{"kind":"Order","metadata":{{"name":"', CAST(o_orderkey AS STRING), '","namespace":"', o_orderstatus,
              '","resourceVersion":"', CAST(CAST(FLOOR(o_totalprice) AS BIGINT)
                  - CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS STRING),
              '"}},"spec":{{"customer":', CAST(o_custkey + CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS STRING),
              ',"priority":"', o_orderpriority, '"}}}}') AS doc
FROM {orders}
WHERE o_orderdate < DATE '2001-01-01'
"""

# A message log.
MESSAGES = """
SELECT event_id AS seq, CAST(event_id AS STRING) AS msg_id, ts,
       CONCAT('shop/v1/', CASE user_id % 3 WHEN 0 THEN 'runtimealerts' WHEN 1 THEN 'carts' ELSE 'orders' END) AS kind,
       'default' AS ns, CAST(user_id AS STRING) AS name,
       CONCAT('a', CAST(user_id % 10 AS STRING)) AS account, CONCAT('c', CAST(user_id % 3 AS STRING)) AS cluster,
       CASE event_type WHEN 'view' THEN 'VerifyObject' WHEN 'click' THEN 'PatchObject'
            WHEN 'purchase' THEN 'PutObject' WHEN 'signup' THEN 'GetObject' ELSE 'DeleteObject' END AS event,
       CAST(event_id % 12 AS INT) AS depth,
       CASE WHEN event_id % 13 = 0 THEN 'own' WHEN event_id % 7 = 0 THEN NULL ELSE '' END AS producer_key,
       props AS payload
FROM {events}
"""

# A watch stream over one object per user.
CHANGES = """
SELECT 'shop/v1/users' AS kind, 'default' AS ns, CAST(user_id AS STRING) AS name,
       CASE event_type WHEN 'signup' THEN 'Added' WHEN 'error' THEN 'Deleted' ELSE 'Modified' END AS op,
       ts, event_id AS seq, event_id AS version,
       CONCAT('{{"metadata":{{"resourceVersion":"', CAST(event_id AS STRING), '"}},"spec":{{"action":"', event_type,
              '","level":"', CASE WHEN value < 20 THEN 'low' ELSE 'high' END, '"}}}}') AS doc
FROM {events}
"""

# Connection events: a signup connects, an error disconnects the slot's latest connect.
CONNECTIONS = """
SELECT CONCAT('a', CAST(user_id % 10 AS STRING)) AS account, CONCAT('c', CAST(user_id % 3 AS STRING)) AS cluster,
       CAST(user_id AS STRING) AS connection_id, ts, event_id AS seq, 'v1.0.0' AS sync_version,
       CASE event_type WHEN 'signup' THEN 'connect' ELSE 'disconnect' END AS op
FROM {events} WHERE event_type IN ('signup', 'error')
"""

# Clients: one per order, connected when it was placed.
CLIENTS = """
SELECT CONCAT('a', CAST(o_custkey AS STRING)) AS account, CONCAT('c', CAST(o_orderkey AS STRING)) AS cluster,
       CAST(o_orderdate AS TIMESTAMP) AS connection_time, o_orderstatus AS server,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'v0.0.56' WHEN '2-HIGH' THEN 'v0.0.57'
            WHEN '3-MEDIUM' THEN 'v1.2.3-rc.1' WHEN '5-LOW' THEN '' ELSE 'invalid' END AS sync_version
FROM {orders}
"""

# Two states of a document per part. The new one moves the version of large parts, raises
# the price of promo parts, and loses a size, a label or all labels elsewhere.
OLD_PARTS = """
SELECT 'shop/v1/parts' AS kind, 'stock' AS ns, CAST(p_partkey AS STRING) AS name, CAST('1' AS STRING) AS version,
       CONCAT('{{"kind":"Part","metadata":{{"labels":{{"brand":"', p_brand, '","type":"', p_type, '"}},"name":"',
              CAST(p_partkey AS STRING), '","resourceVersion":"1"}},"spec":{{"cents":',
              CAST(CAST(ROUND(p_retailprice * 100) AS BIGINT) AS STRING), ',"size":', CAST(p_size AS STRING), '}}}}') AS doc
FROM {part}
"""

NEW_PARTS = """
SELECT 'shop/v1/parts' AS kind, 'stock' AS ns, CAST(p_partkey AS STRING) AS name,
       CASE WHEN p_size > 20 THEN '2' ELSE '1' END AS version,
       CONCAT('{{"kind":"Part","metadata":{{',
              CASE p_type WHEN 'LARGE' THEN '' WHEN 'SMALL' THEN CONCAT('"labels":{{"brand":"', p_brand, '"}},')
                   ELSE CONCAT('"labels":{{"brand":"', p_brand, '","type":"', p_type, '"}},') END,
              '"name":"', CAST(p_partkey AS STRING), '","resourceVersion":"', CASE WHEN p_size > 20 THEN '2' ELSE '1' END,
              '"}},"spec":{{"cents":',
              CAST(CAST(ROUND(p_retailprice * 100) AS BIGINT) + CASE WHEN p_type = 'PROMO' THEN 100 ELSE 0 END AS STRING),
              CASE WHEN p_size <= 5 THEN '' ELSE CONCAT(',"size":', CAST(p_size AS STRING)) END, '}}}}') AS doc
FROM {part}
"""

# The merge patch from the old to the new document, as text; SQL side only.
PART_PATCH = """
SELECT name, version, old_doc, new_doc, edits,
       CASE WHEN edits = '' THEN '{{}}' ELSE edits END AS patch
FROM (
  SELECT CAST(p_partkey AS STRING) AS name, o.doc AS old_doc, n.doc AS new_doc, n.version AS version,
         CASE WHEN m = '' AND s = '' THEN ''
              ELSE CONCAT('{{', CASE WHEN m = '' THEN '' ELSE CONCAT('"metadata":{{', m, '}}') END,
                          CASE WHEN m <> '' AND s <> '' THEN ',' ELSE '' END,
                          CASE WHEN s = '' THEN '' ELSE CONCAT('"spec":{{', s, '}}') END, '}}') END AS edits
  FROM (
    SELECT p_partkey,
           CONCAT(CASE p_type WHEN 'LARGE' THEN '"labels":null' WHEN 'SMALL' THEN '"labels":{{"type":null}}' ELSE '' END,
                  CASE WHEN p_size > 20 AND p_type IN ('LARGE', 'SMALL') THEN ',' ELSE '' END,
                  CASE WHEN p_size > 20 THEN '"resourceVersion":"2"' ELSE '' END) AS m,
           CONCAT(CASE WHEN p_type = 'PROMO'
                       THEN CONCAT('"cents":', CAST(CAST(ROUND(p_retailprice * 100) AS BIGINT) + 100 AS STRING)) ELSE '' END,
                  CASE WHEN p_type = 'PROMO' AND p_size <= 5 THEN ',' ELSE '' END,
                  CASE WHEN p_size <= 5 THEN '"size":null' ELSE '' END) AS s
    FROM {part}) e
  JOIN old_parts o ON o.name = CAST(p_partkey AS STRING)
  JOIN new_parts n ON n.name = CAST(p_partkey AS STRING)) x
"""

INPUTS = {
    "source": SOURCE,
    "objects": OBJECTS,
    "target": TARGET,
    "messages": MESSAGES,
    "changes": CHANGES,
    "connections": CONNECTIONS,
    "clients": CLIENTS,
    "old_parts": OLD_PARTS,
    "new_parts": NEW_PARTS,
    "part_patch": PART_PATCH,
}

# What the two sides synchronize, and how.
KINDS = [
    ("shop/v1/urgent", "patch"),
    ("shop/v1/high", "patch"),
    ("shop/v1/medium", "copy"),
    ("shop/v1/low", "copy"),
    ("shop/v1/users", "patch"),
    ("shop/v1/parts", "patch"),
    ("shop/v1/carts", "patch"),
    ("shop/v1/orders", "copy"),
]


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; ``heavy`` work per row is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if heavy else df


def derived(spark: SparkSession, sf_dir: str, name: str, heavy: bool | None = None) -> DataFrame:
    """A derived input as DataFrame; inputs with documents are spread over the cores."""
    text = INPUTS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    rows = spark.sql(text, **used)
    return spread(rows) if heavy or (heavy is None and "doc" in rows.columns) else rows


def by_key(spark: SparkSession, sf_dir: str, rows: DataFrame, source: str) -> DataFrame:
    """Rows of documents, one per row of the table ``source``, dealt by their key for the joins that follow."""
    return dealt(rows, KEYS, table(spark, sf_dir, source).count())


def kinds(spark: SparkSession) -> DataFrame:
    return lookup(spark, KINDS, KINDS_SCHEMA)


def with_inputs(*names: str) -> str:
    """WITH clause that defines derived inputs for the SQL twin."""
    texts = [f"{n} AS ({INPUTS[n].format(**{t: t for t in TABLES})})" for n in names]
    return "WITH " + ",\n".join(texts) + "\n"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A literal table for a WITH clause."""
    body = ", ".join("(" + ", ".join("'" + str(v) + "'" for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


KINDS_SQL = values("kinds", "kind, strategy", KINDS)


def query(name: str, oracle: str | None = None):
    """Register a query and its SQL twin."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the tables hold naive UTC times
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
