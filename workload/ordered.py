"""Order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.operators import changes as ch
from lockstep.operators import clients as cl
from lockstep.operators.ordered import last_by_key, micros, state_before
from workload.base import CONNECTIONS, derived, query, with_inputs

# Two hours, at which the events of a user form real bursts.
GAP = 7200

CONNECTIONS_SQL = f"""
connections AS (
  SELECT * FROM (
    SELECT *, max(CASE WHEN op = 'connect' THEN ts END) OVER (PARTITION BY connection_id ORDER BY ts, seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS connection_time
    FROM ({CONNECTIONS.format(events='events')}) c) d
  WHERE connection_time IS NOT NULL)
"""

LIVE_SQL = """
live AS (
  SELECT n.* FROM (
    SELECT * FROM connections WHERE op = 'connect'
    QUALIFY row_number() OVER (PARTITION BY account, cluster ORDER BY connection_time DESC, ts DESC, seq DESC) = 1) n
  WHERE NOT EXISTS (SELECT 1 FROM connections d WHERE d.op = 'disconnect' AND d.account = n.account
                    AND d.cluster = n.cluster AND d.connection_id = n.connection_id
                    AND d.connection_time = n.connection_time))
"""


def connections(spark, sf_dir):
    """Connection events; a disconnect carries the time of its slot's latest connect."""
    rows = derived(spark, sf_dir, "connections")
    connected = F.when(F.col("op") == "connect", F.col("ts"))
    timed = state_before(rows, ["connection_id"], "ts", "seq", "connection_time", connected, inclusive=True)
    return timed.where(F.col("connection_time").isNotNull())


DEBOUNCE_SQL = (
    with_inputs("changes")
    + f"""
    , gaps AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {GAP * 1_000_000} THEN 0 ELSE 1 END AS starts
               FROM changes WINDOW w AS (PARTITION BY name ORDER BY ts, seq)),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY name ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS no FROM gaps)
    """
)


@query(
    "debounce",
    DEBOUNCE_SQL
    + """
    SELECT name, max_by(op, seq) AS op, max(seq) AS seq, epoch_us(max(ts)) AS at, count(*) AS n_events
    FROM numbered GROUP BY name, no
    """,
)
def debounce(spark, sf_dir):
    last = ch.debounce(derived(spark, sf_dir, "changes"), gap_seconds=GAP)
    return last.select("name", "op", "seq", micros(F.col("ts")).alias("at"), "n_events")


CHANGE_OPS_SQL = (
    with_inputs("changes")
    + """
    , lives AS (SELECT *, sum(CASE WHEN op = 'Deleted' THEN 1 ELSE 0 END)
                          OVER (PARTITION BY name ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS life FROM changes),
    seen AS (SELECT *, lag(doc) OVER (PARTITION BY name, life ORDER BY ts, seq) AS known FROM lives WHERE op = 'Modified'),
    parts AS (SELECT *, json_extract_string(doc, '$.spec.action') AS action, json_extract_string(known, '$.spec.action') AS was_action,
                     json_extract_string(doc, '$.spec.level') AS level, json_extract_string(known, '$.spec.level') AS was_level FROM seen),
    sent AS (
      SELECT seq, 'PutObject' AS event, doc AS body, sha256(doc) AS checksum FROM parts WHERE known IS NULL
      UNION ALL
      SELECT seq, 'PatchObject',
             concat('{"metadata":{"resourceVersion":"', seq, '"},"spec":{',
                    CASE WHEN action <> was_action THEN concat('"action":"', action, '"') ELSE '' END,
                    CASE WHEN action <> was_action AND level <> was_level THEN ',' ELSE '' END,
                    CASE WHEN level <> was_level THEN concat('"level":"', level, '"') ELSE '' END, '}}'), sha256(doc)
      FROM parts WHERE known IS NOT NULL AND (action <> was_action OR level <> was_level)
      UNION ALL
      SELECT seq, CASE op WHEN 'Added' THEN 'VerifyObject' ELSE 'DeleteObject' END, NULL,
             CASE op WHEN 'Added' THEN sha256(doc) END
      FROM changes WHERE op <> 'Modified')
    SELECT seq, event, body, checksum FROM sent
    """
)


@query("change_ops", CHANGE_OPS_SQL)
def change_ops(spark, sf_dir):
    sent = ch.change_ops(derived(spark, sf_dir, "changes"))
    return sent.select("seq", "event", F.coalesce("patch", "object").alias("body"), "checksum")


@query(
    "live_connections",
    f"WITH {CONNECTIONS_SQL}, {LIVE_SQL} SELECT account, cluster, connection_id, epoch_us(connection_time) AS since FROM live",
)
def live_connections(spark, sf_dir):
    live = cl.live_connections(connections(spark, sf_dir))
    return live.select("account", "cluster", "connection_id", micros(F.col("connection_time")).alias("since"))


@query(
    "last_by_key",
    with_inputs("changes")
    + """
    SELECT name, op, seq, sha256(doc) AS digest FROM changes
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1
    """,
)
def last_row_by_key(spark, sf_dir):
    last = last_by_key(derived(spark, sf_dir, "changes"), ["kind", "ns", "name"], "seq")
    return last.select("name", "op", "seq", F.sha2("doc", 256).alias("digest"))


# Connects that were long on their way: each slot's times lie some hours to days before its arrivals.
LATE_SQL = f"""
{CONNECTIONS_SQL},
arrived AS (SELECT account, cluster, op, ts, seq, connection_time - to_hours(CAST(connection_id AS BIGINT) % 97) AS t FROM connections),
spans AS (
  SELECT k.account, k.cluster, k.ts, k.seq, arg_min(e.op, (e.ts, e.seq)) AS ended_by, min((e.ts, e.seq)) FILTER (WHERE e.seq IS NOT NULL) AS ended
  FROM arrived k LEFT JOIN arrived e ON e.account = k.account AND e.cluster = k.cluster AND (e.ts, e.seq) > (k.ts, k.seq) AND e.t >= k.t
  WHERE k.op = 'connect' GROUP BY k.account, k.cluster, k.ts, k.seq, k.t)
"""


def late_connections(spark, sf_dir):
    hours = F.make_interval(hours=F.col("connection_id").cast("bigint").cast("int") % 97)
    return connections(spark, sf_dir).withColumn("connection_time", F.col("connection_time") - hours)


@query(
    "disconnect_counts_late",
    f"""
    WITH {LATE_SQL}
    SELECT k.account, k.cluster, count(*) AS n_disconnects FROM spans k
    WHERE k.ended_by = 'disconnect' AND NOT EXISTS (
      SELECT 1 FROM spans j WHERE j.account = k.account AND j.cluster = k.cluster AND (j.ts, j.seq) < (k.ts, k.seq)
      AND (j.ended IS NULL OR j.ended > (k.ts, k.seq)))
    GROUP BY ALL
    """,
)
def disconnect_counts_late(spark, sf_dir):
    return cl.disconnect_counts(late_connections(spark, sf_dir))


@query(
    "route_as_of",
    with_inputs("messages")
    + f""", {LATE_SQL}
    SELECT seq, event FROM messages m
    WHERE EXISTS (SELECT 1 FROM spans k WHERE k.account = m.account AND k.cluster = m.cluster AND k.ts <= m.ts
                  AND (k.ended IS NULL OR k.ended[1] > m.ts))
    """,
)
def route_as_of(spark, sf_dir):
    return cl.route_as_of(derived(spark, sf_dir, "messages"), late_connections(spark, sf_dir)).select("seq", "event")
