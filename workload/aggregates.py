"""Aggregations, batches and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.cluster import checked_broadcast
from lockstep.model import DEFAULT_BATCH
from lockstep.operators import batches as bt
from lockstep.operators import clients as cl
from lockstep.operators.guards import reconcile_targets
from lockstep.operators.messages import merge_message_streams, message_metrics
from lockstep.operators.store import fold_batches
from workload.base import derived, kinds, query, table, with_inputs
from workload.filters import DUE_SQL, NOW
from workload.ordered import CONNECTIONS_SQL, LIVE_SQL, connections


@query(
    "message_metrics",
    with_inputs("messages")
    + """
    SELECT CASE WHEN depth > 10 THEN 'error' ELSE 'success' END AS status, event AS event_type,
           split_part(kind, '/', 3) AS kind, account, cluster, count(*) AS n_messages, sum(strlen(payload)) AS payload_bytes
    FROM messages GROUP BY ALL
    """,
)
def metrics(spark, sf_dir):
    rows = derived(spark, sf_dir, "messages").withColumns(
        {
            "status": F.when(F.col("depth") > 10, "error").otherwise("success"),
            "event_type": F.col("event"),
            "kind": F.substring_index("kind", "/", -1),
        }
    )
    return message_metrics(rows)


@query(
    "disconnect_counts",
    f"""
    WITH {CONNECTIONS_SQL},
    seen AS (SELECT *, max(CASE WHEN op = 'connect' THEN seq END) OVER (PARTITION BY account, cluster ORDER BY ts, seq
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM connections)
    SELECT account, cluster, count(*) AS n_disconnects FROM (
      SELECT DISTINCT s.account, s.cluster, s.connection_id, s.connection_time
      FROM seen s JOIN connections c ON c.seq = s.newest
      WHERE s.op = 'disconnect' AND c.connection_id = s.connection_id AND c.connection_time = s.connection_time) d
    GROUP BY ALL
    """,
)
def disconnect_counts(spark, sf_dir):
    return cl.disconnect_counts(connections(spark, sf_dir))


@query("connected_count", f"WITH {CONNECTIONS_SQL}, {LIVE_SQL} SELECT count(*) AS n_connected FROM live")
def connected_count(spark, sf_dir):
    return cl.connected_count(connections(spark, sf_dir))


@query(
    "connected_report",
    with_inputs("clients")
    + """
    SELECT server, CAST(year(connection_time) AS VARCHAR) AS tick, account, cluster, sync_version,
           count(*) OVER (PARTITION BY server, year(connection_time)) AS reported
    FROM clients
    """,
)
def connected_report(spark, sf_dir):
    clients = derived(spark, sf_dir, "clients").withColumn("tick", F.year("connection_time").cast("string"))
    reports = cl.connected_report(clients, max_clients=500)
    totals = reports.groupBy("server", "tick").agg(F.sum("n_clients").alias("reported"))
    listed = reports.select("server", "tick", F.explode("clients").alias("c"))
    return listed.join(checked_broadcast(totals), ["server", "tick"]).select(
        "server", "tick", "c.account", "c.cluster", "c.sync_version", "reported"
    )


@query(
    "request_batch",
    with_inputs("clients") + f"SELECT account, cluster, 1 AS server_initiated FROM ({DUE_SQL}) d",
)
def request_batch(spark, sf_dir):
    due = reconcile_targets(derived(spark, sf_dir, "clients"), NOW, 3600)
    requests = cl.request_batch(due, max_requests=500).select(F.explode("requests").alias("r"))
    return requests.select("r.account", "r.cluster", F.col("r.server_initiated").cast("int").alias("server_initiated"))


RECONCILIATION = """
SELECT CONCAT('{{"account":"a', CAST(o_custkey AS STRING), '","cluster":"c1","depth":1,"msgId":"', CAST(o_orderkey AS STRING),
              '","serverInitiated":true,"kindToObject":{{"shop/v1/orders":[{{"checksum":"k1","resourceVersion":', CAST(o_custkey AS STRING),
              ',"name":"n1","namespace":"', o_orderstatus, '"}},{{"checksum":"k2","resourceVersion":7,"name":"n2","namespace":"x"}}],"',
              CASE o_orderpriority WHEN '1-URGENT' THEN 'no-kind' ELSE 'shop/v1/notes' END,
              '":[{{"checksum":"k3","resourceVersion":9,"name":"n3","namespace":"y"}}]}}}}') AS payload
FROM {orders}
"""


@query(
    "unpack_reconciliation",
    """
    WITH o AS (SELECT concat('a', o_custkey) AS account, CAST(o_orderkey AS VARCHAR) AS msg_id, o_custkey, o_orderstatus, o_orderpriority FROM orders)
    SELECT 'row' AS flow, account, msg_id, 'shop/v1/orders' AS kind, o_orderstatus AS ns, 'n1' AS name, o_custkey AS version, 'k1' AS checksum FROM o
    UNION ALL SELECT 'row', account, msg_id, 'shop/v1/orders', 'x', 'n2', 7, 'k2' FROM o
    UNION ALL SELECT 'row', account, msg_id, 'shop/v1/notes', 'y', 'n3', 9, 'k3' FROM o WHERE o_orderpriority <> '1-URGENT'
    UNION ALL SELECT 'rejected', account, msg_id, 'no-kind', '', '', 1, '' FROM o WHERE o_orderpriority = '1-URGENT'
    """,
)
def unpack_reconciliation(spark, sf_dir):
    rows, bad = bt.unpack_reconciliation(spark.sql(RECONCILIATION, orders=table(spark, sf_dir, "orders")))
    columns = ["flow", "account", "msg_id", "kind", "ns", "name", "version", "checksum"]
    rejected = bad.withColumns(
        {
            "flow": F.lit("rejected"),
            "version": F.col("n_objects").cast("bigint"),
            **{c: F.lit("") for c in ("ns", "name", "checksum")},
        }
    )
    return rows.withColumn("flow", F.lit("row")).select(columns).unionByName(rejected.select(columns))


def batch_messages(spark, sf_dir):
    kind_of = F.when(F.col("depth") < 6, "").otherwise("reconciliation")
    hour = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH")  # what a client gathers in an hour is one message
    return derived(spark, sf_dir, "messages").withColumns(
        {"batch_type": kind_of, "object": F.col("payload"), "msg_id": hour}
    )


@query(
    "pack_batches",
    with_inputs("messages")
    + """
    , m AS (SELECT *, strftime(ts, '%Y-%m-%d %H') AS hour,
                   CASE WHEN depth < 6 THEN '' ELSE 'reconciliation' END AS type FROM messages)
    SELECT account, cluster, hour AS msg_id, kind, type AS batch_type, count(*) AS n_items, max(depth) AS depth,
           coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (event = 'GetObject'), '') AS gets,
           coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (event = 'VerifyObject'), '') AS verifies,
           coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (event = 'DeleteObject'), '') AS deletes,
           coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (event = 'PatchObject'), '') AS patches,
           coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (event = 'PutObject'), '') AS puts
    FROM m GROUP BY account, cluster, hour, kind, type
    """,
)
def pack_batches(spark, sf_dir):
    packed = bt.pack_batches(batch_messages(spark, sf_dir))
    lists = {
        "gets": "getObject",
        "verifies": "newChecksum",
        "deletes": "objectDeleted",
        "patches": "patchObject",
        "puts": "putObject",
    }
    return packed.select(
        *["account", "cluster", "msg_id", "kind", "batch_type", "depth", "n_items"],
        *[F.array_join(F.col(f"items.{name}.seq").cast("array<string>"), ",").alias(n) for n, name in lists.items()],
    )


@query(
    "unpack_batches",
    with_inputs("messages")
    + """
    , ranked AS (SELECT *, strftime(ts, '%Y-%m-%d %H') AS hour, CASE WHEN depth < 6 THEN '' ELSE 'reconciliation' END AS batch_type,
                        CASE event WHEN 'GetObject' THEN 0 WHEN 'VerifyObject' THEN 1 WHEN 'DeleteObject' THEN 2
                                   WHEN 'PatchObject' THEN 3 ELSE 4 END AS op_rank FROM messages)
    SELECT account, cluster, hour AS msg_id, kind, batch_type, op_rank, event, seq, name, payload AS object,
           row_number() OVER (PARTITION BY account, cluster, hour, kind, batch_type, op_rank ORDER BY seq) - 1 AS pos
    FROM ranked
    """,
)
def unpack_batches(spark, sf_dir):
    rows = bt.unpack_batches(bt.pack_batches(batch_messages(spark, sf_dir)))
    owner = ["account", "cluster", "msg_id", "kind", "batch_type"]
    return rows.select(*owner, "op_rank", "event", "seq", "name", "object", F.col("pos").cast("bigint").alias("pos"))


@query(
    "dispatch_batches",
    with_inputs("messages")
    + """
    SELECT seq, CASE event WHEN 'PutObject' THEN 'rejected' WHEN 'VerifyObject' THEN 'reconciliation' ELSE 'default' END AS flow
    FROM messages
    """,
)
def dispatch_batches(spark, sf_dir):
    batch_type = (
        F.when(F.col("event") == "PutObject", "other")
        .when(F.col("event") == "VerifyObject", "reconciliation")
        .otherwise("")
    )
    rows = derived(spark, sf_dir, "messages").withColumn("batch_type", batch_type)
    handlers = {
        "": lambda df: df.select("seq", F.lit("default").alias("flow")),
        "reconciliation": lambda df: df.select("seq", F.lit("reconciliation").alias("flow")),
    }
    handled, rejected = bt.dispatch_batches(rows, handlers)
    return handled.unionByName(rejected.select("seq", F.lit("rejected").alias("flow")))


@query(
    "merge_streams",
    with_inputs("messages", "changes")
    + """
    SELECT seq, account, event, NULL AS op FROM messages UNION ALL SELECT seq, NULL, NULL, op FROM changes
    """,
)
def merge_streams(spark, sf_dir):
    messages = derived(spark, sf_dir, "messages").select("seq", "account", "event")
    return merge_message_streams(messages, derived(spark, sf_dir, "changes").select("seq", "op"))


# A store with one object per customer, and batches of messages from the event log. A patch
# moves an object to the event's number; every patch of a value above 50 announces a wrong checksum.
STORE = """
SELECT CONCAT('shop/v1/', CASE c_custkey % 3 WHEN 0 THEN 'runtimealerts' WHEN 1 THEN 'carts' ELSE 'orders' END) AS kind,
       'default' AS ns, CAST(c_custkey AS STRING) AS name, CAST('-1' AS STRING) AS version,
       '{{"metadata":{{"resourceVersion":"-1"}},"spec":{{"a":0,"b":"x"}}}}' AS doc
FROM {customer}
"""

ROW_SQL = """
SELECT m.kind, m.ns, m.name, m.seq, CASE WHEN m.event = 'DeleteObject' AND m.account <> 'a1' THEN 'PatchObject' ELSE m.event END AS event,
       e.value,
       concat('{"metadata":{"resourceVersion":"', m.seq, '"},"spec":{"a":', m.seq, ',"b":"x"}}') AS patched,
       concat('{"metadata":{"resourceVersion":"', m.seq, '"},"spec":{"put":true}}') AS object
FROM messages m JOIN events e ON e.event_id = m.seq
"""


def batched(spark, sf_dir):
    """The event log as messages that belong to one batch per kind."""
    number = F.col("seq").cast("string")
    patched = F.concat(
        F.lit('{"metadata":{"resourceVersion":"'), number, F.lit('"},"spec":{"a":'), number, F.lit(',"b":"x"}}')
    )
    change = F.concat(F.lit('{"spec":{"a":'), number, F.lit('},"metadata":{"resourceVersion":"'), number, F.lit('"}}'))
    event = F.when((F.col("event") == "DeleteObject") & (F.col("account") != "a1"), "PatchObject").otherwise(F.col("event"))
    values = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value")
    rows = derived(spark, sf_dir, "messages").join(values, "seq")
    return rows.withColumns(
        {
            "event": event,
            "batch_type": F.lit(DEFAULT_BATCH),
            "version": number,
            "checksum": F.when(F.col("value") > 50, "off").otherwise(F.sha2(patched, 256)),
            "patch": change,
            "object": F.concat(F.lit('{"metadata":{"resourceVersion":"'), number, F.lit('"},"spec":{"put":true}}')),
        }
    )


@query(
    "fold_batches",
    with_inputs("messages")
    + f", store AS ({STORE.format(customer='customer')}), items AS ({ROW_SQL})"
    + """
    , gone AS (SELECT DISTINCT kind, name FROM items WHERE event = 'DeleteObject'),
    kept AS (SELECT * FROM store s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.kind = s.kind AND g.name = s.name)),
    tries AS (SELECT i.*, k.doc AS first_doc,
                     max(CASE WHEN i.value <= 50 THEN i.seq END) OVER (PARTITION BY i.kind, i.name ORDER BY i.seq
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_seq
              FROM items i LEFT JOIN kept k ON k.kind = i.kind AND k.name = i.name WHERE i.event = 'PatchObject'),
    done AS (SELECT kind, name, max(seq) AS seq FROM tries WHERE first_doc IS NOT NULL AND value <= 50 GROUP BY ALL),
    puts AS (SELECT kind, name, max(seq) AS seq FROM items WHERE event = 'PutObject' GROUP BY ALL),
    patched AS (SELECT k.kind, k.name, coalesce(d.seq, -1) AS seq,
                       CASE WHEN d.seq IS NULL THEN k.doc
                            ELSE concat('{"metadata":{"resourceVersion":"', d.seq, '"},"spec":{"a":', d.seq, ',"b":"x"}}') END AS doc
                FROM kept k LEFT JOIN done d ON d.kind = k.kind AND d.name = k.name)
    SELECT 'store' AS flow, coalesce(p.kind, q.kind) AS kind, coalesce(p.name, q.name) AS name,
           CASE WHEN p.seq IS NULL OR q.seq > p.seq THEN q.seq ELSE p.seq END AS seq,
           CASE WHEN p.seq IS NULL OR q.seq > p.seq THEN concat('{"metadata":{"resourceVersion":"', q.seq, '"},"spec":{"put":true}}') ELSE p.doc END AS doc
    FROM patched p FULL OUTER JOIN puts q ON p.kind = q.kind AND p.name = q.name
    UNION ALL
    SELECT 'request', kind, name, seq,
           CASE WHEN first_doc IS NULL THEN '' WHEN before_seq IS NULL THEN first_doc
                ELSE concat('{"metadata":{"resourceVersion":"', before_seq, '"},"spec":{"a":', before_seq, ',"b":"x"}}') END
    FROM tries WHERE first_doc IS NULL OR value > 50
    UNION ALL
    SELECT 'request', i.kind, i.name, i.seq, coalesce(s.doc, '') FROM items i LEFT JOIN store s ON s.kind = i.kind AND s.name = i.name
    WHERE i.event = 'VerifyObject'
    UNION ALL
    SELECT 'answer', i.kind, i.name, i.seq, s.doc FROM items i JOIN store s ON s.kind = i.kind AND s.name = i.name
    WHERE i.event = 'GetObject'
    """,
)
def fold(spark, sf_dir):
    store = spark.sql(STORE, customer=table(spark, sf_dir, "customer"))
    packed = bt.pack_batches(batched(spark, sf_dir).drop("msg_id"))
    done = fold_batches(store, packed, kinds(spark))
    after = done.store.select(
        F.lit("store").alias("flow"), "kind", "name", F.col("version").cast("bigint").alias("seq"), "doc"
    )
    asked = done.requests.select(
        F.lit("request").alias("flow"), "kind", "name", "seq", F.coalesce("base_object", F.lit("")).alias("doc")
    )
    told = done.answers.select(
        F.lit("answer").alias("flow"), "kind", "name", "seq", F.coalesce("object", "patch").alias("doc")
    )
    return after.unionByName(asked).unionByName(told)
