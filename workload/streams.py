"""Streaming queries, run over what is there and then compared as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.operators.ordered import micros
from lockstep.streaming import queries as st
from workload.base import derived, query, with_inputs
from workload.ordered import (
    CHANGE_OPS_SQL,
    CONNECTIONS_SQL,
    DEBOUNCE_SQL,
    GAP,
    LIVE_SQL,
    connections,
)
from workload.filters import DUE_SQL
from workload.tables import scratch


def replayed(spark, df, slices: int, start, at="ts"):
    """Feed the rows as ``slices`` appends in the order of ``at``, and run the stream after each of them.

    ``start`` gets the stream and returns a running query; the last one is returned.
    """
    path = scratch(spark, "stream")
    columns = df.columns
    df = df.withColumn("_at", at if not isinstance(at, str) else F.col(at))
    cuts = df.agg(F.min("_at").alias("low"), F.max("_at").alias("high")).first()
    step = (cuts["high"] - cuts["low"]) / slices
    run = None
    for i in range(slices):
        rows = df.where(F.col("_at") >= F.lit(cuts["low"] + i * step))
        if i < slices - 1:
            rows = rows.where(F.col("_at") < F.lit(cuts["low"] + (i + 1) * step))
        rows = rows.select(*columns)
        rows.write.mode("append").parquet(path)
        run = start(spark.readStream.schema(rows.schema).parquet(path))
        run.awaitTermination()
    return run


def finish(query) -> None:
    query.awaitTermination()


def appending(path: str):
    """Sink that writes each batch to its own folder, so a repeated batch replaces itself."""
    return lambda df, batch_id: df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def as_utc(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_debounce",
    DEBOUNCE_SQL
    + "SELECT name, max_by(op, seq) AS op, max(seq) AS seq, count(*) AS n_events, 'burst' AS flow FROM numbered GROUP BY name, no",
)
def stream_debounce(spark, sf_dir):
    """Every burst, the last ones too; a third of the users send their changes a slice late. What is too late would come as a row of its own."""
    out, late, open_at, checkpoint = (scratch(spark, name) for name in ("debounced", "late", "open", "cp"))
    changes = as_utc(derived(spark, sf_dir, "changes"))
    slices = 3
    span = changes.agg(((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1_000_000).alias("s")).first()["s"]
    bursts = st.open_bursts(changes, open_at, gap_seconds=GAP)
    behind = F.when(F.pmod(F.xxhash64("name"), F.lit(3)) == 0, F.col("ts") + F.make_dt_interval(secs=F.lit(span / slices)))
    delay = int(span / slices) * 2 + 1

    def start(stream):
        return st.stream_debounce(stream, bursts, checkpoint, appending(out), appending(late), delay)

    run = replayed(spark, changes, slices, start, F.coalesce(behind, "ts"))
    st.close_bursts(spark, bursts, run.lastProgress["batchId"] + 1, appending(out))
    lost = spark.read.schema(changes.schema).parquet(late).select("name", "op", "seq", F.lit(1).alias("n_events"), F.lit("late").alias("flow"))
    return spark.read.parquet(out).select("name", "op", "seq", "n_events", F.lit("burst").alias("flow")).unionByName(lost)


@query("stream_change_ops", CHANGE_OPS_SQL)
def stream_change_ops(spark, sf_dir):
    out, known, checkpoint = (scratch(spark, name) for name in ("sent", "known", "cp"))

    def start(changes):
        return st.stream_change_ops(changes, known, checkpoint, appending(out))

    replayed(spark, as_utc(derived(spark, sf_dir, "changes")), 3, start)
    sent = spark.read.parquet(out)
    return sent.select("seq", "event", F.coalesce("patch", "object").alias("body"), "checksum")


@query(
    "stream_connections",
    f"WITH {CONNECTIONS_SQL}, {LIVE_SQL} SELECT account, cluster, connection_id, epoch_us(connection_time) AS since FROM live",
)
def stream_connections(spark, sf_dir):
    state_path, out, checkpoint = (scratch(spark, name) for name in ("clients", "told", "cp"))

    def start(events):
        return st.stream_connections(events, state_path, checkpoint, appending(out))

    run = replayed(spark, as_utc(connections(spark, sf_dir)), 3, start)
    live = st.connection_state(state_path).after(spark, run.lastProgress["batchId"])
    return live.select("account", "cluster", "connection_id", micros(F.col("connection_time")).alias("since"))


@query(
    "resume",
    with_inputs("changes") + "SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS run, seq FROM changes",
)
def resume(spark, sf_dir):
    """Two runs of one stream: the second only sees what came after the first."""
    rows = as_utc(derived(spark, sf_dir, "changes")).select("seq", "ts")
    path, checkpoint, out = scratch(spark, "in"), scratch(spark, "cp"), scratch(spark, "out")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    for number, part in enumerate([rows.where(early), rows.where(~early)], start=1):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        finish(st.run(stream, checkpoint, lambda df, i, n=number: appending(f"{out}/run={n}")(df, i)))
    return spark.read.parquet(out).select("run", "seq")


PLAN_SQL = f"""
, due AS ({DUE_SQL}),
objects AS (SELECT kind, ns, name, version, concat('c', name) AS cluster FROM source),
copies AS (SELECT kind, ns, name, version, concat('c', name) AS cluster FROM target),
mine AS (SELECT * FROM objects WHERE cluster IN (SELECT cluster FROM due)),
theirs AS (SELECT * FROM copies WHERE cluster IN (SELECT cluster FROM due))
SELECT coalesce(m.cluster, t.cluster) AS cluster, coalesce(m.name, t.name) AS name,
       CASE WHEN m.name IS NULL THEN 'delete' WHEN t.name IS NULL THEN 'verify' ELSE 'put' END AS op
FROM mine m FULL OUTER JOIN theirs t ON m.cluster = t.cluster AND m.kind = t.kind AND m.ns = t.ns AND m.name = t.name
WHERE m.name IS NULL OR t.name IS NULL OR m.version <> t.version
"""


@query("periodic_reconcile", with_inputs("clients", "source", "target") + PLAN_SQL)
def periodic_reconcile(spark, sf_dir):
    """One timer tick at the end of 1999 over all clients and both snapshots."""
    clients = derived(spark, sf_dir, "clients")
    owner = clients.select("account", "cluster", F.substring("cluster", F.lit(2), F.length("cluster")).alias("name"))
    source = derived(spark, sf_dir, "source").join(owner, "name")
    target = derived(spark, sf_dir, "target").join(owner, "name")
    ticks = scratch(spark, "ticks")
    moment = F.lit("2000-01-01").cast("timestamp")
    clients.agg(F.least(F.max(F.col("connection_time").cast("timestamp")), moment).alias("ts")).write.parquet(ticks)
    out = scratch(spark, "plans")

    def tick(batch, now):
        return st.reconcile_tick(clients, source, target, now, 3600)

    stream = spark.readStream.schema("ts timestamp").parquet(ticks)
    finish(st.periodic_reconcile(stream, tick, scratch(spark, "cp"), lambda done, i: appending(out)(done.plan, i)))
    return spark.read.parquet(out).select("cluster", "name", "op")


# Watches of three kinds that an error ends; the versions of some objects lag behind by hours, and some rows name no object.
WATCHED = """
SELECT CONCAT('shop/v1/k', CAST(user_id % 3 AS STRING)) AS kind, ts, event_id AS seq,
       CASE WHEN event_id % 50 = 7 THEN NULL ELSE CAST(user_id AS STRING) END AS name,
       CAST(CAST({seconds} AS BIGINT) - 3600 * (user_id % 40) AS STRING) AS version,
       CASE event_type WHEN 'signup' THEN 'Added' WHEN 'purchase' THEN 'Deleted' WHEN 'error' THEN 'Error' ELSE 'Modified' END AS op
FROM {events}
"""


@query(
    "stream_changes",
    f"""
    WITH w AS ({WATCHED.format(seconds="epoch_us(ts) // 1000000", events="events").replace("STRING", "VARCHAR")}),
    r AS (SELECT *, CASE WHEN op = 'Error' THEN 'error' WHEN name IS NULL THEN 'no object' END AS why FROM w),
    s AS (SELECT *, max(CASE WHEN why IS NULL THEN CAST(version AS BIGINT) END) OVER (PARTITION BY kind ORDER BY ts, seq
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r),
    t AS (SELECT *, max(CASE WHEN op = 'Error' THEN seen END) OVER (PARTITION BY kind ORDER BY ts, seq
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM s)
    SELECT kind, name, version, op, seq,
           coalesce(why, CASE WHEN CAST(version AS BIGINT) <= since THEN 'repeated' ELSE 'usable' END) AS flow
    FROM t
    """,
)
def stream_changes(spark, sf_dir):
    state_path, used, refused, checkpoint = (scratch(spark, name) for name in ("watch", "usable", "rejected", "cp"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    watched = spark.sql(WATCHED.replace("{seconds}", "unix_seconds(ts)"), events=events)

    def start(stream):
        return st.stream_changes(stream, state_path, checkpoint, appending(used), appending(refused))

    replayed(spark, watched, 3, start)
    columns = ["kind", "name", "version", "op", "seq"]
    usable = spark.read.parquet(used).select(*columns, F.lit("usable").alias("flow"))
    return usable.unionByName(spark.read.parquet(refused).select(*columns, F.col("reason").alias("flow")))
