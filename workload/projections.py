"""Projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.functions import documents as docs
from lockstep.functions import identity as ident
from lockstep.operators import messages as msg
from lockstep.operators.paths import clean_objects, mask_env, merge_maps, stamp_type
from workload.base import derived, query, table, with_inputs


@query(
    "with_identity",
    with_inputs("messages")
    + """
    SELECT msg_id, concat(kind, '/', ns, '/', name) AS object_key,
           concat('shop/v1/User/', ns, '/', name) AS event_key,
           concat(account, '/', cluster) AS client_key,
           concat(account, '/', cluster, '/', msg_id) AS connection_key
    FROM messages
    """,
)
def with_identity(spark, sf_dir):
    rows = derived(spark, sf_dir, "messages").withColumns(
        {"object_kind": F.lit("User"), "connection_id": F.col("msg_id")}
    )
    return ident.with_identity(rows).select("msg_id", "object_key", "event_key", "client_key", "connection_key")


@query(
    "parse_kind",
    """
    SELECT page_id,
           CASE WHEN len(string_split(t, '/')) = 3 THEN string_split(t, '/')[1] END AS "group",
           CASE WHEN len(string_split(t, '/')) = 3 THEN string_split(t, '/')[2] END AS version,
           CASE WHEN len(string_split(t, '/')) = 3 THEN string_split(t, '/')[3] END AS resource
    FROM (SELECT page_id, replace(url, '://', '-') AS t FROM pages) p
    """,
)
def parse_kind(spark, sf_dir):
    kind = ident.parse_kind(F.replace("url", F.lit("://"), F.lit("-")))
    return table(spark, sf_dir, "pages").withColumn("k", kind).select("page_id", "k.*")


OBJECT_TEXT = """
SELECT p_partkey,
       CONCAT('{{"apiVersion":"', CASE p_type WHEN 'PROMO' THEN 'v1' WHEN 'SMALL' THEN 'Shop.Example/v2/x'
                                  ELSE CONCAT('Shop.Example/V', CAST(p_size AS STRING)) END,
              '","kind":"', p_name, '","metadata":{{"name":"', p_brand, '","resourceVersion":"',
              CASE WHEN p_size > 25 THEN CAST(p_partkey AS STRING) ELSE p_type END, '"',
              CASE WHEN p_size > 10 THEN CONCAT(',"namespace":"', p_type, '"') ELSE '' END, '}}}}') AS doc
FROM {part}
"""


@query(
    "identity_from_object",
    f"""
    SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'v1' ELSE 'shop.example' END AS "group",
           CASE p_type WHEN 'PROMO' THEN 'v1' WHEN 'SMALL' THEN 'v2' ELSE concat('v', p_size) END AS version,
           lower(p_name) AS resource, CASE WHEN p_size > 10 THEN lower(p_type) ELSE '' END AS ns,
           lower(p_brand) AS name, CASE WHEN p_size > 25 THEN p_partkey ELSE 0 END AS resource_version
    FROM part
    """,
)
def identity_from_object(spark, sf_dir):
    rows = spark.sql(OBJECT_TEXT, part=table(spark, sf_dir, "part", heavy=True))
    return rows.withColumn("i", ident.identity_from_object("doc")).select("p_partkey", "i.*")


VERSION_TEXT = """
SELECT o_orderkey,
       CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_orderkey AS STRING) WHEN '2-HIGH' THEN CONCAT('-', CAST(o_orderkey AS STRING))
            WHEN '3-MEDIUM' THEN CONCAT(' ', CAST(o_orderkey AS STRING)) WHEN '5-LOW' THEN CONCAT(CAST(o_orderkey AS STRING), '.0')
            ELSE CONCAT('+', CAST(o_orderkey AS STRING)) END AS a,
       CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS STRING) WHEN 'O' THEN '5' ELSE '' END AS b
FROM {orders}
"""


@query(
    "version_order",
    f"""
    SELECT o_orderkey, coalesce(va, 0) AS version_a, coalesce(vb, 0) AS version_b,
           CASE WHEN coalesce(va > vb, false) THEN 1 ELSE 0 END AS newer
    FROM (SELECT o_orderkey,
                 CASE WHEN regexp_full_match(a, '[+-]?[0-9]+') THEN try_cast(ltrim(a, '+') AS BIGINT) END AS va,
                 CASE WHEN regexp_full_match(b, '[+-]?[0-9]+') THEN try_cast(ltrim(b, '+') AS BIGINT) END AS vb
          FROM ({VERSION_TEXT.format(orders='orders')}) t) x
    """,
)
def version_order(spark, sf_dir):
    rows = spark.sql(VERSION_TEXT, orders=table(spark, sf_dir, "orders"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "o_orderkey",
        ident.to_version(a).alias("version_a"),
        ident.to_version(b).alias("version_b"),
        ident.version_newer(a, b).cast("int").alias("newer"),
    )


@query(
    "semver_filter",
    with_inputs("clients")
    + """
    SELECT account, cluster, sync_version FROM clients
    WHERE regexp_full_match(sync_version, 'v[0-9]+\\.[0-9]+\\.[0-9]+(-[a-z0-9.]+)?')
      AND [CAST(regexp_extract(sync_version, 'v([0-9]+)', 1) AS INT),
           CAST(regexp_extract(sync_version, 'v[0-9]+\\.([0-9]+)', 1) AS INT),
           CAST(regexp_extract(sync_version, 'v[0-9]+\\.[0-9]+\\.([0-9]+)', 1) AS INT)] >= [0, 0, 57]
    """,
)
def semver_filter(spark, sf_dir):
    rows = derived(spark, sf_dir, "clients").where(ident.supports_batch(F.col("sync_version")))
    return rows.select("account", "cluster", "sync_version")


@query(
    "message_lineage",
    with_inputs("messages")
    + """
    SELECT seq, msg_id, coalesce(CASE WHEN depth > 3 THEN depth END, 0) + 1 AS depth FROM messages
    """,
)
def message_lineage(spark, sf_dir):
    rows = derived(spark, sf_dir, "messages").withColumn("depth", F.when(F.col("depth") > 3, F.col("depth")))
    return ident.lineage(rows).select("seq", "msg_id", "depth")


NODES = """
SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN '/v1/nodes' WHEN c_mktsegment = 'BUILDING'
                             THEN 'x/v1beta1/sbomsyfts' ELSE '/v1/pods' END AS kind,
       CONCAT('{{"metadata":{{"annotations":{{"kubectl.kubernetes.io/last-applied-configuration":"', c_name, '"',
              CASE WHEN c_acctbal > 0 THEN ',"note":"x"' ELSE '' END,
              '}},"managedFields":[{{"manager":"', c_name, '"}}],"name":"', c_name,
              '"}},"spec":{{"syft":{{"descriptor":{{"a":{{"b":1}}}},"files":[1,2],"rest":"', c_mktsegment,
              '"}}}},"status":{{"conditions":[{{"type":"Ready"}}],"phase":"', c_mktsegment, '"}}}}') AS doc
FROM {customer}
"""


@query(
    "clean_objects",
    """
    SELECT c_custkey AS id,
           concat('{"metadata":{"annotations":{', CASE WHEN c_acctbal > 0 THEN '"note":"x"' ELSE '' END,
                  '},"name":"', c_name, '"},"spec":{"syft":{"descriptor":',
                  CASE WHEN c_mktsegment = 'BUILDING' THEN 'null,"files":null' ELSE '{"a":{"b":1}},"files":[1,2]' END,
                  ',"rest":"', c_mktsegment, '"}},"status":{"conditions":',
                  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'null' ELSE '[{"type":"Ready"}]' END,
                  ',"phase":"', c_mktsegment, '"}}') AS doc
    FROM customer
    """,
)
def clean(spark, sf_dir):
    rows = spark.sql(NODES, customer=table(spark, sf_dir, "customer", heavy=True))
    return clean_objects(rows).select("id", "doc")


@query(
    "stamp_type",
    """
    SELECT p_partkey, concat('{"apiVersion":"shop/v1","kind":"Part","name":"', p_name, '"}') AS doc FROM part
    """,
)
def stamp(spark, sf_dir):
    rows = table(spark, sf_dir, "part", heavy=True).select(
        "p_partkey", F.lit("shop/v1/parts").alias("kind"), F.to_json(F.struct(F.col("p_name").alias("name"))).alias("doc")
    )
    return stamp_type(rows, "'Part'").select("p_partkey", "doc")


WORKLOADS = """
SELECT p_partkey,
       CASE p_type WHEN 'PROMO' THEN CONCAT('{{"kind":"Pod","spec":{{"ephemeralContainers":', c, '}}}}')
                   WHEN 'SMALL' THEN CONCAT('{{"kind":"CronJob","spec":{{"jobTemplate":{{"spec":{{"template":{{"spec":{{"initContainers":', c, '}}}}}}}}}}}}')
                   WHEN 'LARGE' THEN CONCAT('{{"kind":"Service","spec":{{"containers":', c, '}}}}')
                   ELSE CONCAT('{{"kind":"Deployment","spec":{{"template":{{"spec":{{"containers":', c, '}}}}}}}}') END AS doc
FROM (SELECT p_partkey, p_type,
             CONCAT('[{{"env":[{{"name":"A","value":"', p_name, '"}},{{"name":"B","valueFrom":{{"key":"', p_brand,
                    '"}}}},"odd"],"image":"', p_brand, '"}},{{"name":"', p_name, '"}}]') AS c FROM {part}) x
"""


@query(
    "mask_values",
    f"""
    SELECT p_partkey,
           CASE WHEN doc LIKE '{{"kind":"Service"%' THEN doc
                ELSE regexp_replace(doc, '"value":"[^"]*"', '"value":"XXXXXX"') END AS doc
    FROM ({WORKLOADS.format(part='part')}) w
    """,
)
def mask_values(spark, sf_dir):
    rows = spark.sql(WORKLOADS, part=table(spark, sf_dir, "part", heavy=True))
    return mask_env(rows).select("p_partkey", "doc")


@query(
    "merge_maps",
    """
    SELECT p_partkey, p_brand AS brand, CASE WHEN p_type = 'PROMO' THEN CAST(p_size AS VARCHAR) ELSE 'old' END AS size,
           p_name AS name
    FROM part
    """,
)
def merge_maps_query(spark, sf_dir):
    old = F.when(
        F.col("p_type") != "PROMO", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.lit("old"))
    )
    new = F.create_map(
        F.lit("brand"),
        F.when(F.col("p_type") == "PROMO", F.col("p_brand")).otherwise("new"),
        F.lit("size"),
        F.col("p_size").cast("string"),
        F.lit("name"),
        F.col("p_name"),
    )
    merged = table(spark, sf_dir, "part").withColumn("m", merge_maps(old, new))
    return merged.select("p_partkey", *[F.col("m")[k].alias(k) for k in ("brand", "size", "name")])


@query(
    "merge_metadata",
    with_inputs("old_parts", "new_parts")
    + """
    SELECT o.name,
           concat('{"kind":"Part","metadata":{"labels":{"brand":"', p_brand, '","type":"', p_type,
                  '"},"name":"', o.name, '","resourceVersion":"1"},"spec":',
                  substr(n.doc, strpos(n.doc, '"spec":') + 7)) AS doc
    FROM old_parts o JOIN new_parts n ON o.name = n.name JOIN part ON CAST(p_partkey AS VARCHAR) = o.name
    """,
)
def merge_metadata_query(spark, sf_dir):
    old = derived(spark, sf_dir, "old_parts").select("name", F.col("doc").alias("old"))
    new = derived(spark, sf_dir, "new_parts").select("name", F.col("doc").alias("new"))
    return old.join(new, "name").select("name", docs.merge_metadata("old", "new").alias("doc"))


@query(
    "checksum",
    """
    SELECT event_id, CASE WHEN event_type = 'view' THEN 'known'
                          WHEN event_type = 'click' THEN NULL
                          ELSE sha256(replace(props, ' ', '')) END AS checksum
    FROM events
    """,
)
def checksum(spark, sf_dir):
    doc = F.when(F.col("event_type") == "click", F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    noted = F.when(F.col("event_type") == "view", F.lit("known"))
    events = table(spark, sf_dir, "events", heavy=True).withColumns({"doc": doc, "noted": noted})
    return events.select("event_id", docs.checksum("doc", "noted").alias("checksum"))


@query(
    "json_equal",
    """
    SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS equal FROM events
    """,
)
def json_equal(spark, sf_dir):
    props, kind = F.col("props"), F.col("event_type")
    a = F.concat(F.lit('{"a": 1.0, "p":'), props, F.lit("}"))
    b = (
        F.when(kind == "view", F.concat(F.lit('{"p":'), F.replace(props, F.lit(" ")), F.lit(',"a":1}')))
        .when(kind == "click", a)
        .when(kind == "error", F.concat(a, F.lit("}")))
        .otherwise(F.concat(F.lit('{"a":2,"p":'), props, F.lit("}")))
    )
    events = table(spark, sf_dir, "events", heavy=True).withColumns({"a": a, "b": b})
    return events.select("event_id", docs.json_equal("a", "b").cast("int").alias("equal"))


SOCKET = """
SELECT seq, CASE WHEN event = 'GetObject' AND depth = 5 THEN '' WHEN event = 'GetObject' AND depth = 6 THEN '{{"Depth":'
                 ELSE CONCAT('{{"Depth":', CAST(depth AS STRING), ',"Event":',
                    CASE event WHEN 'VerifyObject' THEN '0' WHEN 'PatchObject' THEN '5' WHEN 'PutObject' THEN '6'
                               WHEN 'GetObject' THEN '99' ELSE '7' END,
                    ',"Kind":{{"Group":"shop","Version":"v1","Resource":"carts"}},"MsgId":"', msg_id, '","Name":"', name,
                    '","Namespace":"', ns, '","Checksum":"k","Object":"o', name, '"}}') END AS payload
FROM {messages}
"""


@query(
    "decode_messages",
    with_inputs("messages")
    + """
    SELECT seq, CASE WHEN bad = 0 THEN depth ELSE 0 END AS depth,
           CASE WHEN bad = 0 THEN msg_id END AS msg_id,
           CASE WHEN bad = 0 THEN CASE event WHEN 'VerifyObject' THEN 'newChecksum' WHEN 'PatchObject' THEN 'patchObject'
                          WHEN 'PutObject' THEN 'putObject' WHEN 'DeleteObject' THEN 'ping' END END AS event,
           CASE WHEN bad = 0 THEN 'shop/v1/carts' END AS kind,
           CASE WHEN event IN ('VerifyObject', 'PatchObject', 'PutObject') THEN name END AS name,
           CASE WHEN event IN ('VerifyObject', 'PatchObject', 'PutObject') THEN 'k' END AS checksum,
           CASE WHEN event IN ('VerifyObject', 'PatchObject', 'PutObject') THEN concat('o', name) END AS object,
           CASE WHEN bad = 1 THEN 'empty' WHEN bad = 2 THEN 'undecodable'
                WHEN event = 'GetObject' THEN 'unknown event' END AS error
    FROM (SELECT *, CASE WHEN event = 'GetObject' AND depth = 5 THEN 1
                         WHEN event = 'GetObject' AND depth = 6 THEN 2 ELSE 0 END AS bad FROM messages) m
    """,
)
def decode_messages(spark, sf_dir):
    decoded = msg.decode_socket_messages(socket_rows(spark, sf_dir))
    return decoded.select("seq", "depth", "msg_id", "event", "kind", "name", "checksum", "object", "error")


def socket_rows(spark, sf_dir):
    """Socket messages: some empty, some cut off, some with an unknown number."""
    return spark.sql(SOCKET, messages=derived(spark, sf_dir, "messages", heavy=True))


@query(
    "decode_log",
    with_inputs("messages")
    + """
    SELECT seq, CASE WHEN event <> 'GetObject' THEN name END AS name,
           CASE event WHEN 'PatchObject' THEN payload END AS patch,
           CASE event WHEN 'PutObject' THEN payload END AS object,
           CASE WHEN event = 'GetObject' THEN 'unknown event' END AS error
    FROM messages
    """,
)
def decode_log(spark, sf_dir):
    rows = derived(spark, sf_dir, "messages", heavy=True).withColumns(
        {"object": F.col("payload"), "patch": F.col("payload"), "checksum": F.lit("k")}
    )
    sent = rows.select(
        "seq",
        F.when(F.col("event") == "GetObject", "Other").otherwise(F.col("event")).alias("event"),
        msg.log_body(rows).alias("payload"),
    )
    return msg.decode_log_messages(sent).select("seq", "name", "patch", "object", "error")
