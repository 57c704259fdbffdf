import json

import pytest
from pyspark.sql import functions as F

from lockstep.cluster import MAX_LOOKUP_ROWS, lookup
from lockstep.model import KINDS_SCHEMA
from lockstep.operators import guards, scope
from tests.helpers import rows

WORKLOAD = "n string, ns string, object_kind string, owners array<struct<apiVersion:string,kind:string>>, labels map<string,string>"


def workloads(spark):
    data = [
        ("free pod", "default", "Pod", [], {}),
        ("owned by batch", "default", "Pod", [("batch/v1", "Job")], {}),
        ("hashed", "default", "Pod", None, {"pod-template-hash": "x"}),
        ("empty hash", "default", "Pod", [], {"pod-template-hash": ""}),
        # the first owner decides, and the hash is no longer looked at
        ("foreign owner", "default", "Pod", [("v1", "Node"), ("apps/v1", "ReplicaSet")], {"pod-template-hash": "x"}),
        ("owned deployment", "default", "Deployment", [("apps/v1", "X")], {}),
        ("excluded", "kube-system", "Pod", [], {}),
        ("operator's own", "operator", "Pod", [("apps/v1", "ReplicaSet")], {}),
        ("cluster wide", "", "Node", None, None),
        ("no namespace", None, "Job", [("batch/v1beta1", "CronJob")], {}),
    ]
    return spark.createDataFrame(data, WORKLOAD)


def names(df):
    return {r.n for r in df.collect()}


def test_scope(spark):
    df = workloads(spark)
    free = {"free pod", "empty hash", "foreign owner", "owned deployment", "excluded", "cluster wide"}
    assert names(scope.owned_filter(df)) == free
    kept = names(scope.in_scope(df, "operator", exclude=["kube-system"]))
    assert kept == free - {"excluded"} | {"operator's own"}
    # an include list wins over the exclude list
    only = names(scope.in_scope(df, "operator", include=["kube-system"], exclude=["kube-system"]))
    assert only == {"excluded", "operator's own", "cluster wide"}


def test_message_guards(spark):
    df = spark.createDataFrame(
        [("a", 8, "own", "PutObject", "g/v1/runtimealerts", "foo", "é" * 5),
         ("b", 9, None, "PutObject", "g/v1/runtimealerts", None, "12345"),
         ("c", None, "", "GetObject", "g/v1/runtimealerts", "foo", "é" * 50),
         ("d", 1, "x", "PutObject", "g/v1/pods", "foo", None)],
        "n string, depth int, producer_key string, event string, kind string, account string, payload string",
    )
    assert names(guards.depth_guard(df)) == {"a", "c", "d"}
    assert names(guards.drop_own_messages(df, "own")) == {"b", "c", "d"}
    assert names(guards.mute_accounts(df, ["foo", "bar"])) == {"b", "c", "d"}
    assert names(guards.mute_accounts(df, [])) == {"a", "b", "c", "d"}
    # ten bytes, five characters
    assert names(guards.size_guard(df, 9)) == {"b", "c", "d"}
    assert names(guards.size_guard(df, 10)) == {"a", "b", "c", "d"}
    assert names(guards.size_guard(df, "0")) == {"c", "d"}
    for none in (None, "", "x", -1, "-5"):
        assert names(guards.size_guard(df, none)) == {"a", "b", "c", "d"}


def test_configured_kinds(spark):
    df = spark.createDataFrame([("k1",), ("k2",), (None,)], "kind string")
    kept, audit = scope.configured_kinds(df, lookup(spark, [("k1", "copy")], KINDS_SCHEMA))
    assert rows(kept, "kind") == [("k1",)]
    assert rows(audit, "kind") == [("k2",), (None,)]


def test_long_lookups_are_not_broadcast(spark):
    few = lookup(spark, [("k", "copy")], KINDS_SCHEMA)
    many = lookup(spark, [(f"k{i}", "copy") for i in range(MAX_LOOKUP_ROWS + 1)], KINDS_SCHEMA)
    assert "ResolvedHint" in few._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in many._jdf.queryExecution().analyzed().toString()
    assert many.count() == MAX_LOOKUP_ROWS + 1


ALERT = json.dumps({"apiVersion": "demo/v1", "kind": "Alerts", "metadata": {"name": "N"}})


@pytest.mark.parametrize(
    "method, path, body, status",
    [
        ("POST", "/apis/v1/demo/v1/alerts", ALERT, 202),
        ("POST", "/APIS/V1/Demo/v1/Alerts", ALERT, 202),
        ("POST", "/apis/v1/demo/v1", ALERT, 400),
        ("POST", "/apis/v1/demo/v1/alerts/x", ALERT, 400),
        ("POST", "apis/v1/demo/v1/alerts/", ALERT, 400),
        ("POST", "/apis/v2/demo/v1/alerts", ALERT, 400),
        ("POST", "/apis/v1//v1/alerts", ALERT, 400),
        ("PUT", "/apis/v1/demo/v1/alerts", ALERT, 405),
        ("DELETE", "/apis/v1/demo/v1/alerts", ALERT, 405),
        ("COPY", "/apis/v1/demo/v1/alerts", ALERT, 202),
        ("POST", "/apis/v1/other/v1/alerts", ALERT, 404),
        ("POST", "/apis/v1/demo/v2/alerts", ALERT, 404),
        ("POST", "/apis/v1/demo/v1/other", ALERT, 404),
        ("POST", "/apis/v1/demo/v1/alerts", None, 400),
        ("POST", "/apis/v1/demo/v1/alerts", "", 500),
        ("POST", "/apis/v1/demo/v1/alerts", "no json", 500),
        ("POST", "/apis/v1/demo/v1/alerts", '{"apiVersion":"demo/v1"}', 500),
        ("POST", "/apis/v1/demo/v1/alerts", ALERT.replace("Alerts", "Other"), 400),
    ],
)
def test_ingest(spark, method, path, body, status):
    df = spark.createDataFrame([(method, path, body)], "method string, path string, body string")
    row = guards.validate_ingest(df, [("copy", "demo", "v1", "alerts")]).first()
    assert row.status == status
    assert (row.identity is not None) == (status == 202)
    if status == 202:
        assert row.strategy == "copy" and row.identity.name == "n"


def test_connections(spark):
    df = spark.createDataFrame(
        [("k", "a", "c", "v1", 200), ("", "a", "c", "v1", 401), ("k", None, "c", "invalid", 401), ("k", "a", "", None, 401),
         ("k", "a", "c", "invalid", 424), ("k", "a", "c", None, 200)],
        "access_key string, account string, cluster string, version string, want int",
    )
    assert guards.validate_connections(df).where("status <> want").count() == 0


def test_reconcile_targets(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    df = spark.createDataFrame(
        [("exact", "2024-01-01 00:00:00", "v1.0.0"), ("young", "2024-01-01 00:00:01", "v1.0.0"), ("old", "2023-01-01 00:00:00", "v0.0.56")],
        "n string, t string, sync_version string",
    ).withColumn("connection_time", F.col("t").cast("timestamp"))
    assert names(guards.reconcile_targets(df, now, 3600)) == {"exact"}


def test_ingest_without_routes(spark):
    df = spark.createDataFrame([("POST", "/apis/v1/demo/v1/alerts", ALERT)], "method string, path string, body string")
    assert guards.validate_ingest(df, []).first().status == 405
