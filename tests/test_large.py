"""What keeps time and memory in bounds on large tables."""

from glob import glob

from pyspark.sql import functions as F

from lockstep.cluster import ROWS_PER_TASK, dealt
from lockstep.functions import trees
from lockstep.operators import chains
from lockstep.operators import store as st
from lockstep.streaming.state import KeyedState


def test_deep_texts_are_cut_into_the_leaves_that_unfolding_finds(spark):
    texts = [
        '{"a":{"b":{"c":{"d":{"e":{"f":1,"g":{}},"h":"x:y}{"},"i":null}}},"j":-1.5}',
        '{"a":{"b":{"c":{"d":{"e":{"f":":x"}}}}}}',  # looks like the end of a name
        '{"a":{"b":{"c":{"d":{"e":{"x/y":1}}}}}}',
        '{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}}',
        '{"a": {"b":{"c":{"d":{"e":{"f":1}}}}}}',
        '{"":{"":{"":{"":{"":{"é":true}}}}}}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "d string").withColumn("cut", F.expr(trees.pieces("d")))
    rows = df.select("cut", F.expr(trees.leaves("d")).alias("t"), F.expr(trees.leaves("concat(' ', d)")).alias("u")).collect()
    assert [r["cut"] is not None for r in rows] == [True, False, False, False, False, True]
    assert [sorted(r["t"] or []) for r in rows] == [sorted(r["u"] or []) for r in rows]
    assert len(rows[0]["t"]) == 5 and rows[3]["t"] is None


def test_tasks_are_dealt_by_rows(spark):
    rows = spark.range(ROWS_PER_TASK * 10).withColumn("half", F.col("id") * 2)
    tasks = dealt(rows, ["id"], ROWS_PER_TASK * 10).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 10 and max(t["count"] for t in tasks) < ROWS_PER_TASK * 1.2


def test_only_edits_that_last_are_composed(spark):
    def one(leaves, gone="false"):
        return chains.edit(gone, leaves=f"array({', '.join(trees.pair(trees.text(p), trees.text(v)) for p, v in leaves)})" if leaves else "array()")

    edits = [one([("/a", "1")]), one([("/a/b", "2")]), one([("/c", "{}")]), one([("/a", "3"), ("/c", "1")]), one([("/a", "4")]), one([], "true")]
    kept = spark.range(1).select(F.expr(chains.lasting(f"array({', '.join(edits)})")).alias("k")).first()["k"]
    assert [[tuple(x) for x in e["leaves"]] for e in kept] == [
        [("/a/b", "2")], [("/c", "{}")], [("/a", "3"), ("/c", "1")], [("/a", "4")], [],
    ]


def test_a_step_takes_one_checksum(spark, monkeypatch):
    """Three make the fold of a long run half slower again."""
    store = spark.createDataFrame([("k", "n", "x", "1", "{}")], "kind string, ns string, name string, version string, doc string")
    sent = spark.createDataFrame([("k", "n", "x", 1, "PatchObject", "off", "{}")], "kind string, ns string, name string, seq int, event string, checksum string, patch string")
    steps, fold = [], st.fold_runs
    monkeypatch.setattr(st, "fold_runs", lambda held, events, keys, step, *rest: steps.append(step) or fold(held, events, keys, step, *rest))
    st.replay(store, sent)
    assert steps[0]("s", "m").count("sha2(") == 1


def test_a_bucket_is_written_by_few_tasks(spark, tmp_path):
    state = KeyedState(str(tmp_path), ["k"], "k bigint, v bigint, live boolean", buckets=2)
    rows = spark.range(0, 4000, 1, 40).select(F.col("id").alias("k"), F.col("id").alias("v"), F.lit(True).alias("live"))
    state.write(spark, rows, 0)
    assert len(glob(f"{tmp_path}/segments/version=0/bucket=*/*.parquet")) <= state.buckets * state.writers
    assert state.after(spark, 0).count() == 4000


def test_events_of_long_runs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def put(n):
        made.add(1)
        return f'{{"metadata":{{"resourceVersion":"{n}"}}}}'

    key = {c: F.lit("k") for c in ("kind", "ns", "name")}
    sent = spark.range(1, 13, 1, 2).select(F.col("id").alias("seq"), F.lit("PutObject").alias("event"), put("id").alias("object"))
    store = spark.range(0).select(F.lit("").alias("version"), F.lit("").alias("doc")).withColumns(key)
    after, _, _ = st.replay(store, sent.withColumns(key), per_round=2)
    assert [r["version"] for r in after.collect()] == ["12"]
    assert made.value <= 24
