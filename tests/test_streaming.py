import os
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lockstep.operators.changes import after_errors, change_ops, debounce
from lockstep.operators.store import apply_changes
from lockstep.sources.merge_store import MergeStore
from lockstep.streaming import queries as st
from lockstep.streaming.state import KeyedState
from tests.helpers import rows
from tests.test_ordered import EVENTS, at, connection_events, walk

CHANGES = "kind string, ns string, name string, op string, ts timestamp, seq bigint, doc string"


def feed(spark, df, path, parts):
    """The rows as files in ``seq`` order, one per micro-batch."""
    bounds = sorted(r.seq for r in df.select("seq").collect())
    step = -(-len(bounds) // parts)
    for i in range(0, len(bounds), step):
        chunk = bounds[i : i + step]
        df.where(F.col("seq").between(chunk[0], chunk[-1])).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def to_folder(path):
    return lambda df, batch_id: df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def changes(spark, n=300):
    rng = random.Random(9)
    data = []
    for i in range(n):
        doc = f'{{"metadata":{{"resourceVersion":"{i}"}},"x":{rng.randint(0, 3)}}}'
        name = rng.choice(["hot", "hot", "a", "b", "c"])
        data.append(("k/v1/x", "ns", name, rng.choice(["Added", "Modified", "Modified", "Modified", "Deleted"]), at(i * 3), i, doc))
    return spark.createDataFrame(data, CHANGES)


def debounced(spark, tmp_path, stream, delay):
    """(given out, late) of a stream of changes, its open bursts closed at the end."""
    bursts = st.open_bursts(stream, f"{tmp_path}/open")
    args = (to_folder(f"{tmp_path}/out"), to_folder(f"{tmp_path}/late"))
    run = st.stream_debounce(stream, bursts, f"{tmp_path}/cp", *args, delay_seconds=delay)
    run.awaitTermination()
    last = run.lastProgress["batchId"]
    for _ in range(2):  # a repeated batch replaces itself
        st.close_bursts(spark, bursts, last + 1, args[0])
    return spark.read.parquet(f"{tmp_path}/out"), spark.read.parquet(f"{tmp_path}/late")


def test_stream_debounce_equals_batch(spark, tmp_path):
    df = changes(spark)
    out, late = debounced(spark, tmp_path, feed(spark, df, f"{tmp_path}/in", 3), 0)
    assert late.count() == 0
    assert rows(out, "name", "seq", "op", "n_events") == rows(debounce(df), "name", "seq", "op", "n_events")


@pytest.mark.parametrize("delay", [0, 40, 10_000])
def test_stream_debounce_keeps_late_changes(spark, tmp_path, delay):
    df = changes(spark, 200)
    # a third of the rows come a while after their time
    shuffled = df.withColumn("seq", F.col("seq") + F.when(F.col("seq") % 3 == 0, F.col("seq") % 17).otherwise(0) * 1000 + F.col("seq"))
    stream = feed(spark, shuffled, f"{tmp_path}/in", 6)
    out, late = debounced(spark, tmp_path, stream, delay)
    in_time = shuffled.join(late.select("seq"), "seq", "left_anti")
    assert rows(out, "name", "seq", "op", "n_events") == rows(debounce(in_time), "name", "seq", "op", "n_events")
    assert out.agg(F.sum("n_events")).first()[0] + late.count() == df.count()
    assert (late.count() == 0) == (delay == 10_000)


def test_bursts_of_clients_are_kept_apart(spark, tmp_path):
    df = changes(spark, 60).withColumns({"account": F.lit("a"), "cluster": F.when(F.col("seq") % 2 == 0, "c1").otherwise("c2")})
    out, _ = debounced(spark, tmp_path, feed(spark, df, f"{tmp_path}/in", 2), 0)
    assert rows(out, "cluster", "name", "seq") == rows(debounce(df), "cluster", "name", "seq")
    assert set(rows(out, "cluster", "name", "seq")) != set(rows(debounce(df, ["kind", "ns", "name"]), "cluster", "name", "seq"))
    stream = feed(spark, df, f"{tmp_path}/in2", 3)
    st.stream_change_ops(stream, f"{tmp_path}/known", f"{tmp_path}/cp2", to_folder(f"{tmp_path}/sent")).awaitTermination()
    columns = ["seq", "event", "patch", "object"]
    assert rows(spark.read.parquet(f"{tmp_path}/sent"), *columns) == rows(change_ops(df), *columns)


def test_stream_change_ops_equals_batch(spark, tmp_path):
    df = changes(spark, 120)
    stream = feed(spark, df, f"{tmp_path}/in", 4)
    st.stream_change_ops(stream, f"{tmp_path}/known", f"{tmp_path}/cp", to_folder(f"{tmp_path}/out")).awaitTermination()
    columns = ["seq", "event", "checksum", "patch", "object"]
    assert rows(spark.read.parquet(f"{tmp_path}/out"), *columns) == rows(change_ops(df), *columns)


@pytest.mark.parametrize("in_order", [True, False])
def test_stream_connections_equals_walk(spark, tmp_path, in_order):
    events = connection_events(random.Random(6), 120, in_order)
    stream = feed(spark, spark.createDataFrame(events, EVENTS), f"{tmp_path}/in", 3)
    run = st.stream_connections(stream, f"{tmp_path}/state", f"{tmp_path}/cp", to_folder(f"{tmp_path}/out"))
    run.awaitTermination()
    live, ended = walk(events)
    state = st.connection_state(f"{tmp_path}/state").after(spark, run.lastProgress["batchId"])
    assert dict(rows(state, "cluster", "connection_id")) == {k: v[0] for k, v in live.items()}
    told = spark.read.parquet(f"{tmp_path}/out")
    counted = told.where("event = 'Disconnected'").groupBy("cluster").count()
    assert dict(rows(counted, "cluster", "count")) == ended
    assert told.where("event = 'ServerConnected' and report is null").count() == 0


def test_resume_does_not_repeat(spark, tmp_path):
    df = changes(spark, 40).select("seq", "ts")
    seen = []

    def each(batch, batch_id):
        seen.append([r.seq for r in batch.select("seq").collect()])

    for part in (df.where("seq < 25"), df.where("seq >= 25"), None):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        st.run(stream, f"{tmp_path}/cp", each).awaitTermination()
    assert [sorted(s) for s in seen] == [list(range(25)), list(range(25, 40))]


def test_keyed_state_compacts_and_repeats(spark, tmp_path):
    state = KeyedState(f"{tmp_path}/s", ["k"], "k string, v int, live boolean", compact_every=3)
    want = {}
    rng = random.Random(1)
    for batch_id in range(8):
        touched = {k: (rng.randint(0, 99), rng.random() < 0.8) for k in rng.sample("abcdefgh", 3)}
        want |= touched
        df = spark.createDataFrame([(k, v, live) for k, (v, live) in touched.items()], state.schema)
        for _ in range(2):  # a repeated batch changes nothing
            state.write(spark, df, batch_id)
        got = dict(rows(state.after(spark, batch_id), "k", "v"))
        assert got == {k: v for k, (v, live) in want.items() if live}


def test_keyed_state_reads_and_writes_what_is_touched(spark, tmp_path):
    state = KeyedState(f"{tmp_path}/s", ["k"], "k bigint, v int, live boolean", compact_every=2, buckets=8, keep_versions=4)
    rows_of = lambda ids, v: spark.createDataFrame([(i, v, True) for i in ids], state.schema)
    state.write(spark, rows_of(range(1000), 0), 0)
    for version in range(1, 12):
        state.write(spark, rows_of([7], version), version)
    folders = sorted(p.name for p in (tmp_path / "s/segments/version=11").iterdir() if p.is_dir())
    assert len(folders) == 1  # the bucket of the one key that was touched
    touched = state.before(spark, 12, rows_of([7], 0))
    assert rows(touched, "k", "v") == [(7, 11)]
    assert all(folders[0] in f for f in touched.inputFiles())
    assert rows(state.after(spark, 11).groupBy("v").count(), "v", "count") == [(0, 999), (11, 1)]
    kept = {p.name for p in (tmp_path / "s/versions").iterdir()}
    assert "version=0" not in kept and "version=7" in kept
    assert rows(state.after(spark, 7).where("k = 7"), "v") == [(7,)]


def test_keyed_state_of_removed_keys(spark, tmp_path):
    state = KeyedState(f"{tmp_path}/s", ["k"], "k string, v int, live boolean", compact_every=1, buckets=2)
    for version, live in enumerate([True, False, False]):
        state.write(spark, spark.createDataFrame([("a", 1, live)], state.schema), version)
        assert state.after(spark, version).count() == int(live)
    state.write(spark, spark.createDataFrame([("a", 5, True)], state.schema), 3)
    assert rows(state.after(spark, 3), "v") == [(5,)]


def size_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_merge_store_equals_full_rewrite(spark, tmp_path):
    rng = random.Random(2)
    keys = ["account", "cluster", "kind", "ns", "name"]
    def objects(names, version):
        return spark.createDataFrame(
            [("a", c, "k", "n", str(i), str(version), f'{{"metadata":{{"resourceVersion":"{version}"}},"x":"{rng.random()}"}}')
             for c in ("c1", "c2") for i in names], ", ".join(f"{k} string" for k in [*keys, "version", "doc"]))

    store = MergeStore(str(tmp_path / "store"), keys, compact_every=3, buckets=16)
    plain = objects(range(2000), 0).cache()
    store.create(plain)
    first = size_of(tmp_path / "store/segments/version=0")
    for batch in range(1, 7):
        changed = objects(rng.sample(range(2100), 3), batch)
        changes = changed.withColumns({"op": F.when(F.rand(batch) < 0.3, "delete").otherwise("put"), "seq": F.lit(1)}).cache()
        changes = changes.unionByName(changes.withColumns({"seq": F.lit(0), "op": F.lit("delete")}))
        store.apply(changes, batch, keep_metadata=batch % 2 == 0)
        store.apply(changes, batch, keep_metadata=batch % 2 == 0)
        plain = apply_changes(plain, changes, keep_metadata=batch % 2 == 0).cache()
        names = ["cluster", "name", "version", "doc"]
        assert rows(store.read(spark, batch), *names) == rows(plain, *names)
        if batch <= 3:
            assert size_of(tmp_path / f"store/segments/version={batch}") < first / 4


def test_connects_that_share_a_number_are_told_once(spark, tmp_path):
    events = connection_events(random.Random(6), 6, True)
    df = spark.createDataFrame(events, EVENTS).where("op = 'connect'").limit(1)
    twice = df.unionByName(df.withColumn("connection_id", F.lit("other")))
    twice.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(twice.schema).parquet(f"{tmp_path}/in")
    st.stream_connections(stream, f"{tmp_path}/state", f"{tmp_path}/cp", to_folder(f"{tmp_path}/out")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_periodic_reconcile(spark, tmp_path):
    clients = spark.createDataFrame(
        [("a", "due", datetime(2024, 1, 1, tzinfo=UTC), "v1.0.0"), ("a", "young", datetime(2024, 1, 2, tzinfo=UTC), "v1.0.0")],
        "account string, cluster string, connection_time timestamp, sync_version string",
    )
    objects = "account string, cluster string, kind string, ns string, name string, version string"
    source = spark.createDataFrame([("a", c, "k", "", n, "1") for c in ("due", "young") for n in ("x", "y")], objects)
    target = spark.createDataFrame([("a", c, "k", "", n, v) for c in ("due", "young") for n, v in (("x", "0"), ("z", "1"))], objects)
    spark.createDataFrame([(datetime(2024, 1, 2, 0, 30, tzinfo=UTC),)], "ts timestamp").write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/ticks")
    seen = {}

    def sink(done, batch_id):
        seen["requests"] = rows(done.requests, "cluster", "event")
        seen["plan"] = rows(done.plan, "cluster", "name", "op")

    st.periodic_reconcile(
        stream, lambda batch, now: st.reconcile_tick(clients, source, target, now, 3600), f"{tmp_path}/cp", sink
    ).awaitTermination()
    assert seen["requests"] == [("due", "ReconciliationRequest")]
    assert seen["plan"] == [("due", "x", "put"), ("due", "y", "verify"), ("due", "z", "delete")]


class Echo:
    """Handlers that note which one was called."""

    def __getattr__(self, name):
        return lambda df: df.withColumn("by", F.lit(name))


def test_handlers(spark):
    events = ["DeleteObject", "GetObject", "PatchObject", "PutObject", "VerifyObject", "batch"]
    df = spark.createDataFrame([(e,) for e in events], "event string")
    assert rows(st.handle(df, Echo()), "by") == [("batch",), ("delete",), ("get",), ("patch",), ("put",), ("verify",)]


def test_stream_changes_resumes_after_errors(spark, tmp_path):
    """Two kinds, errors in the middle and as the last row of a batch, repeats after them, over restarts and a repeated batch."""
    schema = "kind string, name string, version string, op string, ts timestamp, seq bigint"
    rng = random.Random(12)
    data, want, top, resume = [], [], {}, {}
    for i in range(90):
        kind = rng.choice(["k1", "k1", "k2"])
        op = "Error" if i % 30 == 29 or rng.random() < 0.1 else rng.choice(["Added", "Modified", "Deleted", "Modified"])
        name, version = (None if i % 11 == 5 else "n"), ("w1" if i % 17 == 3 else str(i - rng.choice([0, 0, 0, 6])))
        data.append((kind, name, version, op, at(i), i))
        if op == "Error":
            want.append((i, "error"))
            resume[kind] = top.get(kind, -1)
        elif name is None:
            want.append((i, "no object"))
        else:
            whole = version != "w1"
            want.append((i, "repeated" if whole and int(version) <= resume.get(kind, -1) else "usable"))
            if whole:
                top[kind] = max(top.get(kind, -1), int(version))
    assert {w for _, w in want} == {"error", "no object", "repeated", "usable"}
    df = spark.createDataFrame(data, schema)
    told, come = after_errors(df, ranges=5)
    assert rows(told.fillna("usable", ["reason"]), "seq", "reason") == sorted(want, key=repr)
    assert {r["kind"]: r["top"] for r in come.collect()} == top

    for part in range(3):
        df.where(F.col("seq").between(part * 30, part * 30 + 29)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        sinks = (to_folder(f"{tmp_path}/used"), to_folder(f"{tmp_path}/refused"))
        st.stream_changes(stream, f"{tmp_path}/state", f"{tmp_path}/cp", *sinks).awaitTermination()
        if part == 1:  # the last batch is lost after its sinks were written, and comes again
            os.remove(f"{tmp_path}/cp/commits/1")
            crc = f"{tmp_path}/cp/commits/.1.crc"
            if os.path.exists(crc):
                os.remove(crc)
    got = rows(spark.read.parquet(f"{tmp_path}/used").withColumn("reason", F.lit("usable")), "seq", "reason")
    got += rows(spark.read.parquet(f"{tmp_path}/refused"), "seq", "reason")
    assert sorted(got, key=repr) == sorted(want, key=repr)
