"""The plans that matter at scale: what is shuffled, broadcast and pushed down."""

from pyspark.sql import functions as F

from lockstep.operators import store as st
from lockstep.operators.changes import debounce
from lockstep.operators.folds import fold_runs
from lockstep.operators.ordered import last_by_key
from lockstep.operators.reconcile import reconcile
from lockstep.sources import tables as io
from tests.test_ordered import at

OBJECTS = "kind string, ns string, name string, version string, doc string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def objects(spark, n):
    return spark.createDataFrame([("k", "ns", f"n{i}", str(i), f'{{"a":{i}}}') for i in range(n)], OBJECTS)


def test_bucketed_store_is_not_shuffled(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        io.write_store(objects(spark, 100), "plan_store", f"{tmp_path}/store", 4)
        store = io.read_store(spark, "plan_store")
        puts = objects(spark, 10).withColumns({"op": F.lit("put"), "seq": F.lit(1)})
        text = plan(st.apply_changes(store, puts))
        # one exchange, for the changes
        assert text.count("Exchange hashpartitioning") == 1, text
        assert st.apply_changes(store, puts).count() == 100
    finally:
        spark.sql("DROP TABLE IF EXISTS plan_store")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kind_filter_and_columns_reach_the_scan(spark, tmp_path):
    io.write_snapshot(objects(spark, 10), f"{tmp_path}/snap")
    text = plan(io.read_snapshot(spark, f"{tmp_path}/snap", "k").where("name = 'n1'").select("version"))
    assert "PartitionFilters: [isnotnull(kind" in text
    assert "PushedFilters: [IsNotNull(name), EqualTo(name,n1)]" in text
    assert "doc" not in text.split("ReadSchema")[1]


def test_reconcile_moves_keys_and_versions_only(spark, tmp_path):
    objects(spark, 10).write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    text = plan(reconcile(a, a, allow_empty=True))
    assert "doc" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_runs_are_limited_before_the_shuffle(spark):
    state = objects(spark, 3).select("kind", "ns", "name", F.struct("doc").alias("state"))
    events = objects(spark, 3).select("kind", "ns", "name", F.lit(1).alias("seq"), F.struct("doc").alias("event"))
    runs = events.withColumn("_n", F.expr("row_number() OVER (PARTITION BY kind, ns, name ORDER BY seq)")).where("_n <= 256")
    assert "WindowGroupLimit [kind" in plan(runs) and "Partial" in plan(runs)
    after, said = fold_runs(
        state, events, ["kind", "ns", "name"], lambda s, e: f"named_struct('state', named_struct('doc', {e}.doc), 'emit', {s}.doc)"
    )
    assert after.count() == 3 and said.count() == 3


def test_hot_keys_shrink_before_the_shuffle(spark):
    text = plan(last_by_key(objects(spark, 10), ["kind", "ns", "name"], "version"))
    assert "partial_max_by" in text
    df = spark.createDataFrame([("a", at(1), 1)], "k string, ts timestamp, seq int")
    assert "partial_max_by" in plan(debounce(df, ["k"]))
