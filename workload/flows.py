"""The flows of a deployment, from log to store."""

from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.operators import batches as bt
from lockstep.operators import messages as msg
from lockstep.operators.paths import CLIENT, KEYS
from lockstep.operators.ordered import state_before
from lockstep.operators.store import fold_batches, replay
from lockstep.plans.flows import Settings, backend_to_store, cluster_to_backend, ingest_to_log, reconcile_request
from workload.base import KINDS_SQL, derived, kinds, query, table, with_inputs
from workload.filters import ROUTES
from workload.joins import RECONCILE_SQL
from workload.ordered import CHANGE_OPS_SQL

# Everyone's objects have one of 40 names, so that clients share names. Messages are stamped
# with the hour only; within it the offset orders them.
SHARED = """
, sent AS (
  SELECT seq, kind, 'default' AS ns, CAST(CAST(name AS BIGINT) % 40 AS VARCHAR) AS name, account, cluster, event,
         date_trunc('hour', ts) AS hour, coalesce(producer_key, '') AS producer_key,
         concat('{"metadata":{"resourceVersion":"', CASE WHEN seq % 5 = 0 THEN 'v' ELSE '' END, CAST(seq AS VARCHAR), '"}}') AS doc
  FROM messages WHERE depth <= 8)
"""


def shared(spark, sf_dir):
    number = F.col("seq").cast("string")
    version = F.concat(F.when(F.col("seq") % 5 == 0, "v").otherwise(""), number)
    return derived(spark, sf_dir, "messages").withColumns(
        {
            "name": (F.col("name").cast("bigint") % 40).cast("string"),
            "ts": F.date_trunc("hour", F.col("ts").cast("timestamp")),
            "object": F.concat(F.lit('{"metadata":{"resourceVersion":"'), version, F.lit('"}}')),
            "patch": F.lit("{}"),
            "checksum": F.lit("off"),
        }
    )


@query(
    "batch_order",
    with_inputs("messages")
    + SHARED.replace(" WHERE depth <= 8", "")
    + """
    , steps AS (SELECT account, cluster, kind, name, hour, max(CASE WHEN event = 'PutObject' THEN seq END) AS put,
                       max(CASE WHEN event = 'DeleteObject' THEN 1 ELSE 0 END) AS gone FROM sent GROUP BY ALL),
    ended AS (SELECT *, CASE WHEN put IS NOT NULL THEN put WHEN gone = 1 THEN -1 END AS after FROM steps),
    told AS (SELECT *, last_value(after IGNORE NULLS) OVER w AS held,
                    last_value(after IGNORE NULLS) OVER (PARTITION BY account, cluster, kind, name ORDER BY hour
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
                    row_number() OVER (PARTITION BY account, cluster, kind, name ORDER BY hour DESC) AS last
             FROM ended WINDOW w AS (PARTITION BY account, cluster, kind, name ORDER BY hour
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT 'store' AS flow, t.account, t.cluster, t.kind, t.name, t.held AS seq, s.doc
    FROM told t JOIN sent s ON s.seq = t.held WHERE last = 1
    UNION ALL
    SELECT CASE WHEN s.event = 'VerifyObject' THEN 'request' WHEN h.doc IS NULL THEN 'error' ELSE 'answer' END,
           s.account, s.cluster, s.kind, s.name, s.seq, h.doc
    FROM sent s JOIN told t ON t.account = s.account AND t.cluster = s.cluster AND t.kind = s.kind AND t.name = s.name AND t.hour = s.hour
    LEFT JOIN sent h ON h.seq = t.before
    WHERE s.event IN ('VerifyObject', 'GetObject')
    """,
)
def batch_order(spark, sf_dir):
    """A batch per client, kind and hour, each finished before the next; puts and deletes of the same names."""
    rows = shared(spark, sf_dir).where("event <> 'PatchObject'").withColumns(
        {"batch_type": F.lit(""), "hour": F.unix_seconds("ts")}
    )
    packed = bt.pack_batches(rows, by=[*CLIENT, "hour"])
    empty = rows.select(*CLIENT, *KEYS, F.lit("").alias("version"), F.lit("").alias("doc")).where(F.lit(False))
    done = fold_batches(empty, packed, kinds(spark), check=False, order="hour")
    number = F.regexp_extract("doc", "[0-9]+", 0).try_cast("bigint")
    key = [*CLIENT, "kind", "name"]
    return (
        done.store.select(F.lit("store").alias("flow"), *key, number.alias("seq"), "doc")
        .unionByName(done.requests.select(F.lit("request").alias("flow"), *key, "seq", F.col("base_object").alias("doc")))
        .unionByName(done.answers.select(F.lit("answer").alias("flow"), *key, "seq", F.col("object").alias("doc")))
        .unionByName(done.errors.select(F.lit("error").alias("flow"), *key, "seq", F.lit(None).cast("string").alias("doc")))
    )


@query(
    "patch_chain",
    """
    WITH o AS (SELECT o_orderstatus AS name, o_orderkey AS seq, o_orderpriority = '1-URGENT' AS urgent,
                      CASE WHEN o_custkey % 2 = 0 THEN concat('{"by":', o_custkey, '}') ELSE CAST(o_custkey AS VARCHAR) END AS value,
                      row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey DESC) = 1 AS refused
               FROM orders),
    s AS (SELECT name, seq, refused,
                 concat('{"metadata":{"resourceVersion":"', coalesce(max(CASE WHEN NOT refused THEN seq END) OVER w, -1),
                        '"},"spec":{"other":', coalesce(last_value(CASE WHEN NOT refused AND NOT urgent THEN value END IGNORE NULLS) OVER w, '0'),
                        ',"urgent":', coalesce(last_value(CASE WHEN NOT refused AND urgent THEN value END IGNORE NULLS) OVER w, '0'),
                        '}}') AS doc
          FROM o WINDOW w AS (PARTITION BY name ORDER BY seq))
    SELECT 'store' AS flow, name, max(seq) AS seq, arg_max(doc, seq) AS doc FROM s GROUP BY name
    UNION ALL SELECT 'request', name, seq, doc FROM s WHERE refused
    """,
)
def patch_chain(spark, sf_dir):
    """Every order patches the object of its status, so that each key holds a third of all messages.

    The patch of a status' costliest order announces another checksum and is refused.
    """
    orders = table(spark, sf_dir, "orders")
    text = F.col("o_custkey").cast("string")
    sent = orders.select(
        F.col("o_orderstatus").alias("name"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("other").alias("member"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('{"by":'), text, F.lit("}"))).otherwise(text).alias("value"),
    )
    costliest = F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"]
    refused = orders.groupBy(F.col("o_orderstatus").alias("name")).agg(costliest.alias("refused"))
    sent = sent.join(refused, "name").withColumn("refused", F.col("seq") == F.col("refused"))
    for member in ("urgent", "other"):
        mine = F.when(~F.col("refused") & (F.col("member") == member), F.col("value"))
        sent = state_before(sent, ["name"], "seq", "value", member, mine, inclusive=True)

    def body(*fields):
        head = [F.lit('{"metadata":{"resourceVersion":"'), F.col("seq").cast("string"), F.lit('"},"spec":{')]
        return F.concat(*head, *fields, F.lit("}}"))

    held = [F.coalesce(member, F.lit("0")) for member in ("other", "urgent")]
    after = body(F.lit('"other":'), held[0], F.lit(',"urgent":'), held[1])
    key = {"kind": F.lit("shop/v1/orders"), "ns": F.lit("shop")}
    messages = sent.select(
        "name",
        "seq",
        F.lit("PatchObject").alias("event"),
        F.when(F.col("refused"), "off").otherwise(F.sha2(after, 256)).alias("checksum"),
        body(F.lit('"'), F.col("member"), F.lit('":'), F.col("value")).alias("patch"),
    ).withColumns(key)
    empty = '{"metadata":{"resourceVersion":"-1"},"spec":{"other":0,"urgent":0}}'
    store = refused.select("name", F.lit("-1").alias("version"), F.lit(empty).alias("doc")).withColumns(key)
    done, requests, _ = replay(store, messages)
    last = orders.groupBy(F.col("o_orderstatus").alias("name")).agg(F.max("o_orderkey").alias("seq"))
    return (
        done.join(last, "name").select(F.lit("store").alias("flow"), "name", "seq", "doc")
        .unionByName(requests.select(F.lit("request").alias("flow"), "name", "seq", F.col("base_object").alias("doc")))
    )


@query(
    "backend_to_store",
    with_inputs("messages")
    + f", {KINDS_SQL}"
    + SHARED
    + """
    , heard AS (SELECT s.* FROM sent s SEMI JOIN kinds k ON k.kind = s.kind WHERE producer_key <> 'own' AND account <> 'a9'),
    steps AS (SELECT *, CASE event WHEN 'PutObject' THEN seq WHEN 'DeleteObject' THEN -1 END AS after FROM heard),
    told AS (SELECT *, last_value(after IGNORE NULLS) OVER (PARTITION BY account, cluster, kind, name ORDER BY hour, seq
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held,
                    last_value(after IGNORE NULLS) OVER (PARTITION BY account, cluster, kind, name ORDER BY hour, seq
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
                    row_number() OVER (PARTITION BY account, cluster, kind, name ORDER BY hour DESC, seq DESC) AS last
             FROM steps)
    SELECT 'store' AS flow, t.account, t.cluster, t.kind, t.name, s.doc FROM told t JOIN sent s ON s.seq = t.held WHERE last = 1
    UNION ALL
    SELECT CASE WHEN t.event = 'GetObject' THEN CASE WHEN h.doc IS NULL THEN 'error' ELSE 'answer' END ELSE 'request' END,
           t.account, t.cluster, t.kind, t.name,
           CASE WHEN t.event <> 'PatchObject' OR t.kind = 'shop/v1/carts' THEN h.doc END
    FROM told t LEFT JOIN sent h ON h.seq = t.before WHERE t.event IN ('VerifyObject', 'GetObject', 'PatchObject')
    """,
)
def backend_to_store_query(spark, sf_dir):
    """The log of all clusters into their stores; clients share object names and hours, the offset gives the order."""
    rows = shared(spark, sf_dir)
    sent = msg.envelope(rows.withColumn("version", F.lit("0")), "x", payload=msg.log_body(rows))
    # the producer and the offset, as a broker would keep them
    keyed = rows.select("msg_id", F.coalesce("producer_key", F.lit("")).alias("_key"), F.col("seq").alias("offset"))
    ids = sent.withColumn("msg_id", F.get_json_object("payload", "$.msgId"))
    log = ids.join(keyed, "msg_id").drop("key", "msg_id").withColumnRenamed("_key", "key")
    log = log.withColumn("partition", F.lit(0))
    clients = rows.where("account <> 'a9'").select(*CLIENT).distinct()
    empty = rows.select(*CLIENT, *KEYS, F.lit("").alias("version"), F.lit("").alias("doc")).where(F.lit(False))
    done = backend_to_store(log, clients, kinds(spark), empty, Settings(own_key="own"), keep_metadata=False)
    key = [*CLIENT, "kind", "name"]
    return (
        done.store.select(F.lit("store").alias("flow"), *key, "doc")
        .unionByName(done.requests.select(F.lit("request").alias("flow"), *key, F.col("base_object").alias("doc")))
        .unionByName(done.answers.select(F.lit("answer").alias("flow"), *key, F.col("object").alias("doc")))
        .unionByName(done.errors.select(F.lit("error").alias("flow"), *key, F.lit(None).cast("string").alias("doc")))
    )


# Clients share 40 names; what happens to an object within an hour is one burst.
WATCHED = """
, watched AS (
  SELECT concat('a', CAST(name AS BIGINT) % 10) AS account, concat('c', CAST(name AS BIGINT) % 3) AS cluster,
         CASE WHEN CAST(name AS BIGINT) % 7 = 0 THEN 'kube-system' ELSE 'default' END AS ns,
         CAST(name AS BIGINT) % 40 AS short, op, date_trunc('hour', ts) AS ts, seq, doc FROM changes),
settled AS (
  SELECT *, concat(account, '/', cluster, '/', short) AS name FROM watched WHERE ns <> 'kube-system'
  QUALIFY row_number() OVER (PARTITION BY account, cluster, short, ts ORDER BY seq DESC) = 1)
"""


@query(
    "cluster_to_backend",
    with_inputs("changes")
    + WATCHED
    + CHANGE_OPS_SQL[CHANGE_OPS_SQL.index(", lives AS") :]
    .replace("FROM changes", "FROM settled")
    .replace("SELECT seq, event, body, checksum FROM sent", """
    SELECT w.account, w.cluster, CAST(w.short AS VARCHAR) AS name, s.event, s.body, s.checksum
    FROM sent s JOIN watched w ON w.seq = s.seq"""),
)
def cluster_to_backend_query(spark, sf_dir):
    """The watch streams of all clusters to the log; one namespace is out of scope."""
    user = F.col("name").cast("bigint")
    changes = derived(spark, sf_dir, "changes").withColumns(
        {
            "account": F.concat(F.lit("a"), user % 10),
            "cluster": F.concat(F.lit("c"), user % 3),
            "ns": F.when(user % 7 == 0, "kube-system").otherwise("default"),
            "name": (user % 40).cast("string"),
            "ts": F.date_trunc("hour", F.col("ts").cast("timestamp")),
        }
    )
    settings = Settings(own_key="cluster", operator_ns="operator", exclude=("kube-system",))
    log = cluster_to_backend(changes, kinds(spark), None, None, settings)
    return log.select(
        *[F.col("properties")[p].alias(p) for p in (*CLIENT, "name", "event")],
        F.unbase64(F.get_json_object("payload", "$.patch")).cast("string").alias("body"),
        F.get_json_object("payload", "$.checksum").alias("checksum"),
    )


# Posted orders; finished ones carry a checksum. Alerts are copied, carts are patched.
POSTED = """
SELECT CONCAT('a', CAST(o_custkey AS STRING)) AS account, 'c' AS cluster, CAST(o_orderdate AS TIMESTAMP) AS ts,
       CAST(o_orderkey AS STRING) AS name,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'PUT' WHEN '2-HIGH' THEN 'GET' ELSE 'POST' END AS method,
       CASE WHEN o_totalprice < 100000 THEN '/apis/v1/shop/v1/carts' ELSE '/apis/v1/shop/v1/alerts' END AS path,
       CONCAT('{{"apiVersion":"shop/v1","kind":"', CASE WHEN o_totalprice < 100000 THEN 'Carts' ELSE 'Alerts' END,
              '","metadata":{{', CASE WHEN o_orderstatus = 'F' THEN '"annotations":{{"example.org/sum":"s1"}},' ELSE '' END,
              '"name":"', CAST(o_orderkey AS STRING), '","namespace":"n"}}}}') AS body
FROM {orders}
"""


@query(
    "ingest_to_log",
    f"WITH posted AS ({POSTED.format(orders='orders')}),"
    + """
    judged AS (SELECT *, CASE WHEN method = 'GET' THEN 405 WHEN method = 'PUT' AND path LIKE '%alerts' THEN 404
                              WHEN method = 'POST' AND path LIKE '%carts' THEN 404 ELSE 202 END AS status FROM posted)
    SELECT account, name, status, CASE WHEN status = 202 THEN CASE method WHEN 'PUT' THEN 'PatchObject' ELSE 'PutObject' END END AS event,
           CASE WHEN status = 202 THEN substr(path, 10) END AS kind,
           CASE WHEN status = 202 THEN CASE WHEN contains(body, '"s1"') THEN 's1' ELSE '' END END AS checksum,
           CASE WHEN status = 202 THEN body END AS body
    FROM judged
    """,
)
def ingest_to_log_query(spark, sf_dir):
    posted = spark.sql(POSTED, orders=table(spark, sf_dir, "orders", heavy=True))
    log, refused = ingest_to_log(posted, ROUTES, Settings(own_key="backend"), "example.org/sum")
    sent = log.select(
        *[F.col("properties")[p].alias(p) for p in ("account", "name", "event")],
        F.lit(202).alias("status"),
        F.get_json_object("payload", "$.kind").alias("kind"),
        F.get_json_object("payload", "$.checksum").alias("checksum"),
        F.unbase64(F.get_json_object("payload", "$.patch")).cast("string").alias("body"),
    )
    none = [F.lit(None).cast("string").alias(c) for c in ("event", "kind", "checksum", "body")]
    return sent.unionByName(refused.select("account", "name", "status", *none))


@query(
    "reconcile_request",
    with_inputs("source", "target")
    + f"""
    , plan AS (SELECT *, CAST(name AS BIGINT) // 100 AS c FROM ({RECONCILE_SQL}) r WHERE op <> 'skip'),
    asked AS (SELECT DISTINCT kind, CAST(name AS BIGINT) // 100 AS c FROM target)
    SELECT concat('c', p.c) AS cluster, p.kind, p.ns, p.name,
           CASE op WHEN 'delete' THEN 'DeleteObject' WHEN 'put' THEN 'PutObject' ELSE 'VerifyObject' END AS event,
           CASE WHEN op = 'delete' THEN NULL ELSE sha256(s.doc) END AS checksum,
           CASE WHEN op = 'put' THEN s.doc END AS body, 2 AS depth, concat('m', p.c) AS msg_id
    FROM plan p JOIN asked a ON a.kind = p.kind AND a.c = p.c
    LEFT JOIN source s ON s.kind = p.kind AND s.ns = p.ns AND s.name = p.name
    """,
)
def reconcile_request_query(spark, sf_dir):
    """A client holds a hundred orders; its request lists by kind what the replica has of them."""
    hundred = F.floor(F.col("name").cast("bigint") / 100)
    owner = {"account": F.lit("a"), "cluster": F.concat(F.lit("c"), hundred)}
    source, target = (derived(spark, sf_dir, side).withColumns(owner) for side in ("source", "target"))
    item = F.struct(
        F.sha2("doc", 256).alias("checksum"), F.col("version").alias("resourceVersion"), "name", F.col("ns").alias("namespace")
    )
    kinds_of = target.groupBy(*CLIENT, "kind").agg(F.collect_list(item).alias("items"))
    body = F.struct(
        *CLIENT,
        F.lit(1).alias("depth"),
        F.concat(F.lit("m"), F.substring("cluster", 2, 20)).alias("msgId"),
        F.lit(True).alias("serverInitiated"),
        F.map_from_entries(F.collect_list(F.struct("kind", "items"))).alias("kindToObject"),
    )
    requests = kinds_of.groupBy(*CLIENT).agg(F.to_json(body).alias("payload"))
    log, _ = reconcile_request(requests, source, Settings(own_key="cluster"), F.col("ns") != "P")
    return log.select(
        *[F.col("properties")[p].alias(c) for p, c in (("cluster", "cluster"), ("event", "event"), ("name", "name"), ("namespace", "ns"))],
        *[F.get_json_object("payload", f"$.{p}").alias(c) for p, c in (("kind", "kind"), ("checksum", "checksum"), ("msgId", "msg_id"))],
        F.get_json_object("payload", "$.depth").cast("int").alias("depth"),
        F.unbase64(F.get_json_object("payload", "$.patch")).cast("string").alias("body"),
    )
