import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lockstep.operators import clients as cl
from lockstep.operators.changes import bootstrap, change_ops, debounce
from lockstep.operators.ordered import in_ranges, last_by_key, sessions, state_before
from lockstep.operators.scans import Steps, running
from tests.helpers import rows

START = datetime(2024, 1, 1, tzinfo=UTC)


def at(seconds):
    return START + timedelta(seconds=seconds)


def hot_events(rng, n=400, span=3000):
    """Events of few keys, one of which has most of them."""
    return [
        (rng.choice(["hot", "hot", "hot", "b", "c"]), at(rng.choice([rng.randint(0, span), rng.random() * span])), i, f"v{i}")
        for i in range(n)
    ]


@pytest.mark.parametrize("gap, slice_gaps", [(5, 2), (5, 4096), (17, 1), (60, 3)])
def test_sessions_equal_a_walk(spark, gap, slice_gaps):
    events = hot_events(random.Random(gap))
    df = spark.createDataFrame(events, "k string, ts timestamp, seq bigint, v string").repartition(4)
    got = sessions(df, ["k"], "ts", "seq", gap, slice_gaps).select("k", "n_events", F.col("last_event.seq").alias("seq"))
    want = []
    for key in {e[0] for e in events}:
        run = []
        for e in sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2])):
            if run and e[1] - run[-1][1] > timedelta(seconds=gap):
                want.append((key, len(run), run[-1][2]))
                run = []
            run.append(e)
        want.append((key, len(run), run[-1][2]))
    assert rows(got, "k", "n_events", "seq") == sorted(want, key=repr)


def test_debounce_cases(spark):
    data = [("Deployment", "Added", 0.0), ("Pod", "Added", 0.05), ("Pod", "Modified", 0.1), ("Pod", "Modified", 0.15),
            ("Pod", "Modified", 0.2), ("Pod", "Deleted", 5.2), ("Pod", "Added", 10.3)]
    df = spark.createDataFrame([(k, o, at(t), i) for i, (k, o, t) in enumerate(data)], "k string, op string, ts timestamp, seq int")
    # a gap of exactly five seconds still belongs to the burst
    assert rows(debounce(df, ["k"]), "k", "op", "n_events") == [
        ("Deployment", "Added", 1), ("Pod", "Added", 1), ("Pod", "Deleted", 5),
    ]


@pytest.mark.parametrize("how", ["last", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_state_before_equals_a_walk(spark, how, inclusive):
    rng = random.Random(4)
    events = [(k, t, i, rng.choice([None, rng.randint(0, 99)])) for k, t, i, _ in hot_events(rng)]
    df = spark.createDataFrame(events, "k string, ts timestamp, seq bigint, v int").repartition(4)
    got = state_before(df, ["k"], "ts", "seq", "prev", F.col("v"), how, inclusive, ranges=7)
    want = {}
    for key in {e[0] for e in events}:
        seen = []
        for e in sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2])):
            known = seen + ([e[3]] if inclusive and e[3] is not None else [])
            want[e[2]] = None if not known else known[-1] if how == "last" else max(known)
            if e[3] is not None:
                seen.append(e[3])
    assert dict(rows(got, "seq", "prev")) == want


def test_last_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 2, None)], "k string, pos int, v string")
    assert rows(last_by_key(df, ["k"], "pos"), "k", "pos", "v") == [("a", 3, "y"), ("b", 2, "z")]


CHANGES = "kind string, ns string, name string, op string, ts timestamp, seq bigint, version string, doc string"


def test_change_ops(spark):
    def d(v, x):
        return f'{{"metadata":{{"resourceVersion":"{v}"}},"x":{x}}}'

    steps = [
        ("Added", d(1, 1), "VerifyObject", None),
        ("Modified", d(2, 1), "PutObject", d(2, 1)),  # Added did not make it known
        ("Modified", d(3, 2), "PatchObject", '{"metadata":{"resourceVersion":"3"},"x":2}'),
        ("Modified", d(4, 2), None, None),  # only the version moved
        ("Added", d(4, 2), "VerifyObject", None),
        ("Modified", d(5, 3), "PatchObject", '{"metadata":{"resourceVersion":"5"},"x":3}'),
        ("Deleted", d(6, 3), "DeleteObject", None),
        ("Modified", d(7, 3), "PutObject", d(7, 3)),
    ]
    data = [("k/v1/x", "ns", "n", op, at(i * 900), i, "0", doc) for i, (op, doc, _, _) in enumerate(steps)]
    df = spark.createDataFrame(data, CHANGES)
    got = change_ops(df, ranges=5).withColumn("body", F.coalesce("patch", "object"))
    want = [(i, e, b) for i, (_, _, e, b) in enumerate(steps) if e]
    assert rows(got, "seq", "event", "body") == want


def test_bootstrap_resumes_after_the_highest_listed_version(spark):
    listed = spark.createDataFrame([("k", "", "a", "9", "{}"), ("k", "", "b", "4", "{}")],
                                   "kind string, ns string, name string, version string, doc string")
    changes = spark.createDataFrame([("k", "", "a", "9", "Modified"), ("k", "", "a", "10", "Modified"), ("m", "", "z", "1", "Added")],
                                    "kind string, ns string, name string, version string, op string")
    got = bootstrap(listed, changes)
    assert rows(got, "name", "version", "op") == [
        ("a", "10", "Modified"), ("a", "9", "VerifyObject"), ("b", "4", "VerifyObject"), ("z", "1", "Added"),
    ]


EVENTS = "account string, cluster string, connection_id string, connection_time timestamp, op string, ts timestamp, seq bigint, sync_version string"


def connection_events(rng, n, in_order=True):
    """Connects and disconnects of few clients, one very busy."""
    data, known = [], {}
    for i in range(n):
        client = rng.choice(["hot", "hot", "hot", "x", "y"])
        opened = known.setdefault(client, [])
        if opened and rng.random() < 0.5:
            conn, when = rng.choice(opened)
            data.append(("a", client, conn, when, "disconnect", at(i * 60), i, "v1.0.0"))
        else:
            when = at(i * 60) if in_order else at(rng.randint(0, n) * 60)
            opened.append((f"c{i}", when))
            data.append(("a", client, f"c{i}", when, "connect", at(i * 60), i, "v1.0.0"))
    return data


def walk(events):
    """The live connections event by event, and counted disconnects."""
    live, ended = {}, {}
    for _, cluster, conn, when, op, _, _, _ in sorted(events, key=lambda e: e[6]):
        held = live.get(cluster)
        if held and held[0] != conn and held[1] > when:
            continue
        if op == "connect":
            live[cluster] = (conn, when)
        elif live.pop(cluster, None):
            ended[cluster] = ended.get(cluster, 0) + 1
    return live, ended


def test_live_connections(spark):
    events = connection_events(random.Random(1), 300)
    df = spark.createDataFrame(events, EVENTS).repartition(4)
    live, ended = walk(events)
    assert dict(rows(cl.live_connections(df), "cluster", "connection_id")) == {k: v[0] for k, v in live.items()}
    assert cl.connected_count(df).first()["n_connected"] == len(live)
    assert dict(rows(cl.disconnect_counts(df, ranges=5), "cluster", "n_disconnects")) == ended


def test_equal_connection_time_replaces_and_older_is_refused(spark):
    def e(conn, when, op, seq):
        return ("a", "c", conn, at(when), op, at(seq), seq, "")

    events = [e("one", 5, "connect", 1), e("two", 5, "connect", 2), e("old", 1, "connect", 3), e("old", 1, "disconnect", 4)]
    # only an older disconnect is refused: one of the same time ends the connection, whichever it names
    for events, left in ((events, [("two",)]), ([*events, e("one", 5, "disconnect", 5)], [])):
        assert [(c,) for c, _ in walk(events)[0].values()] == left
        assert rows(cl.live_connections(spark.createDataFrame(events, EVENTS)), "connection_id") == left


@pytest.mark.parametrize("seed", range(4))
def test_live_connections_in_any_order(spark, seed):
    events = connection_events(random.Random(seed), 150, in_order=False)
    df = spark.createDataFrame(events, EVENTS).repartition(5)
    live, ended = walk(events)
    for ranges in (1, 3, 20):
        got = cl.live_connections(df, ranges=ranges)
        assert got.columns == df.columns
        assert dict(rows(got, "cluster", "connection_id")) == {k: v[0] for k, v in live.items()}
        assert dict(rows(cl.disconnect_counts(df, ranges=ranges), "cluster", "n_disconnects")) == ended


def test_bootstrap_by_carried_checksums(spark):
    schema = "kind string, ns string, name string, version string, doc string"
    carried = '{"metadata":{"annotations":{"x/y.z":"mine"}}}'
    listed = spark.createDataFrame([("k", "", "a", "9", carried), ("k", "", "b", "w1", "{}")], schema)
    changes = spark.createDataFrame([("k", "", "a", "w2", "Modified"), ("k", "", "a", "8", "Modified")],
                                    "kind string, ns string, name string, version string, op string")
    got = bootstrap(listed, changes, "x/y.z")
    assert [r for r in rows(got, "name", "version", "op", "checksum") if r[2] == "VerifyObject"][0][3] == "mine"
    assert rows(got.where("op = 'Modified'"), "version") == [("w2",)]
    assert rows(bootstrap(listed, changes).where("name = 'a' and op = 'VerifyObject'"), "checksum") != [("mine",)]


def test_route_as_of_equals_a_walk(spark):
    events = connection_events(random.Random(3), 200, in_order=False)
    # moments between events and at events; one client that never connects, one message without time
    messages = [(c, "a", at(i * 45), i) for i in range(260) for c in ("hot", "x", "none")] + [("hot", "a", None, -1)]
    want = sorted(
        (c, i) for c, _, ts, i in messages if ts is not None and c in walk([e for e in events if e[5] <= ts])[0]
    )
    df = spark.createDataFrame(messages, "cluster string, account string, ts timestamp, no int").repartition(3)
    for ranges in (None, 6):
        got = cl.route_as_of(df, spark.createDataFrame(events, EVENTS), ranges=ranges)
        assert got.columns == df.columns
        assert rows(got, "cluster", "no") == sorted(want, key=repr)
    assert cl.route_as_of(df, spark.createDataFrame([], EVENTS)).count() == 0
    assert cl.disconnect_counts(spark.createDataFrame([], EVENTS)).count() == 0


def test_running_composition_in_small_runs(spark):
    """Affine maps don't commute: any run put in the wrong place shows."""
    rng = random.Random(4)
    data = [("hot" if i % 3 else f"k{i % 5}", i // 2, rng.randint(-1, 1), rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, seq long, a long, b long").select("k", "seq", F.struct("a", "b").alias("event"))
    affine = Steps(
        "struct<a:bigint,b:bigint>", "named_struct('a', 1L, 'b', 0L)", lambda e: e,
        lambda f, g: f"named_struct('a', {f}.a * {g}.a, 'b', {g}.a * {f}.b + {g}.b)",
    )
    want, held = [], {}
    for k, seq, a, b in sorted(data):
        f = held.get(k, (1, 0))
        want.append((k, seq, a, b, *f))
        held[k] = (f[0] * a, a * f[1] + b)
    got = running(df.repartition(4), ["k"], affine, per_run=4, ranges=5)
    assert rows(got, "k", "seq", "event.a", "event.b", "before.a", "before.b") == sorted(want, key=repr)


def test_a_busy_key_fills_many_ranges(spark):
    """One key with all rows of an hour: ranges are equal, and one row each is handed on."""
    df = spark.range(8000).selectExpr("'hot' AS k", "timestamp_seconds(id div 3) AS ts", "id AS seq")
    sizes = [r["count"] for r in in_ranges(df, ["k"], "ts", "seq", ranges=8).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8
    got = state_before(df, ["k"], "ts", "seq", "prev", F.col("seq"), ranges=8)
    assert got.where("prev <=> if(seq = 0, NULL, seq - 1)").count() == 8000
