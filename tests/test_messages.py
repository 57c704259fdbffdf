import base64
import json

import pytest
from pyspark.sql import functions as F

from lockstep.operators import batches as bt
from lockstep.operators import clients as cl
from lockstep.operators import messages as msg
from lockstep.operators.chunks import chunked
from lockstep.operators.guards import quarantine
from lockstep.sources import tables as io
from tests.helpers import rows


def socket(spark, *payloads):
    df = spark.createDataFrame([(p if p is None or isinstance(p, str) else json.dumps(p),) for p in payloads], "payload string")
    return msg.decode_socket_messages(df)


def test_event_numbers(spark):
    df = spark.createDataFrame([(i,) for i in range(-1, 10)], "n int")
    got = [r.e for r in df.select(msg.event_name(F.col("n")).alias("e")).collect()]
    assert got == [None, "newChecksum", "objectAdded", "objectDeleted", "objectModified", "getObject", "patchObject",
                   "putObject", "ping", "batch", None]
    back = spark.createDataFrame([("batch",), ("newChecksum",), ("x",)], "t string")
    assert [r.n for r in back.select(msg.event_number(F.col("t")).alias("n")).collect()] == [8, 0, None]


def test_socket_messages(spark):
    kind = {"Group": "", "Version": "v1", "Resource": "pods"}
    head = {"Depth": 2, "Kind": kind, "MsgId": "m"}
    items = {"PutObject": [{"Name": "a", "Object": "{}"}], "NewChecksum": [{"Name": "b"}, {"Name": "c"}]}
    decoded = socket(
        spark,
        head | {"Event": 0, "Name": "n", "Namespace": "s", "Checksum": "k"},
        head | {"Event": 6, "Name": "n", "Object": '{"a":1}', "ResourceVersion": 4},
        head | {"Event": 5, "Name": "n", "Patch": "p", "Checksum": "k"},
        head | {"Event": 8, "BatchType": "reconciliation", "Items": items},
        {"Event": 7, "MsgId": "m"},
        {"MsgId": "m"},
        {"Event": 42},
        "",
        None,
        "{",
    )
    got = decoded.collect()
    assert [(r.event, r.error) for r in got] == [
        ("newChecksum", None), ("putObject", None), ("patchObject", None), ("batch", None), ("ping", None),
        (None, "no event"), (None, "unknown event"), (None, "empty"), (None, "empty"), (None, "undecodable"),
    ]
    assert (got[0].kind, got[0].ns, got[0].name, got[0].checksum, got[0].depth) == ("/v1/pods", "s", "n", "k", 2)
    assert (got[1].object, got[1].version, got[2].patch) == ('{"a":1}', 4, "p")
    assert got[3].batch.BatchType == "reconciliation" and len(got[3].batch.Items.NewChecksum) == 2
    good, bad = quarantine(decoded)
    assert (good.count(), bad.count()) == (5, 5)


WIDE = ("event string, kind string, ns string, name string, version string, account string, cluster string, depth int, "
        "msg_id string, checksum string, base_object string, patch string, object string, ts timestamp")


def wide(spark, event, account="a", cluster="c"):
    data = [(event, "g/v1/r", "s", "n", "7", account, cluster, 2, "m", "k", "base", "the patch", "the object", None)]
    return spark.createDataFrame(data, WIDE).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def test_envelope_and_back(spark):
    for event in ("GetObject", "PatchObject", "VerifyObject", "PutObject", "DeleteObject"):
        row = msg.envelope(wide(spark, event), "own").first()
        assert row.key == "own"
        assert row.properties == {
            "timestamp": "2024-01-01T00:00:00.000000Z", "event": event, "group": "g", "version": "v1", "resource": "r",
            "name": "n", "namespace": "s", "resourceVersion": "7", "account": "a", "cluster": "c",
        }
        body = json.loads(row.payload)
        assert body["resourceVersion"] == 0 and body["namespace"] == "s" and body["msgId"] == "m"
        sent = {"PutObject": "the object", "PatchObject": "the patch"}.get(event)
        assert body.get("patch") == (base64.b64encode(sent.encode()).decode() if sent else None)
        back = msg.decode_log_messages(
            msg.envelope(wide(spark, event), "own").withColumn("event", F.col("properties")["event"])
        ).first()
        assert (back.name, back.kind, back.depth, back.error) == ("n", "g/v1/r", 2, None)
        assert back.object == (sent if event == "PutObject" else None)
        assert back.patch == (sent if event == "PatchObject" else None)
        assert back.base_object == ("base" if event == "GetObject" else None)


def test_envelope_precedence(spark):
    extra = F.create_map(F.lit("event"), F.lit("Other"), F.lit("account"), F.lit("weak"), F.lit("name"), F.lit("mine"))
    props = msg.envelope(wide(spark, "GetObject"), "own", extra=extra).first().properties
    assert (props["event"], props["account"], props["name"]) == ("Other", "a", "mine")
    props = msg.envelope(wide(spark, "GetObject", account="", cluster=None), "own").first().properties
    assert "account" not in props and "cluster" not in props


def test_unknown_log_events(spark):
    df = spark.createDataFrame([("ConnectedClients", "{}"), ("GetObject", "{"), ("GetObject", '{"kind":"x"}')], "event string, payload string")
    assert [r.error for r in msg.decode_log_messages(df).collect()] == ["unknown event", "undecodable", "unknown kind"]


def test_chunks_keep_every_row(spark):
    data = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(10)]
    df = spark.createDataFrame(data, "k string, i int")
    got = chunked(df, ["k"], 500, ["i"])
    assert got.count() == 3010 and got.distinct().count() == 3010
    sizes = {r["k"]: r for r in got.groupBy("k").agg(F.countDistinct("part").alias("parts")).collect()}
    assert sizes["hot"]["parts"] == 6 and sizes["cold"]["parts"] == 1
    assert got.groupBy("k", "part").count().agg(F.max("count")).first()[0] < 700


def test_batches_there_and_back(spark):
    events = ["GetObject", "VerifyObject", "DeleteObject", "PatchObject", "PutObject"]
    data = [("k", "", events[i % 5], i, f"n{i}", f"o{i}") for i in range(50)] + [("k", "", "Other", 99, "x", "x")]
    df = spark.createDataFrame(data, "kind string, batch_type string, event string, seq bigint, name string, object string")
    one = bt.pack_batches(df).first()
    assert one.n_items == 50 and len(one["items"].putObject) == 10
    assert [i.seq for i in one["items"].getObject] == list(range(0, 50, 5))
    owned = df.withColumns({"account": (F.col("seq") % 3).cast("string"), "cluster": F.lit("c"), "depth": F.lit(2)})
    split = bt.pack_batches(owned)
    # one batch per client, which keeps its owner and depth
    assert rows(split, "account", "cluster", "depth", "n_items") == [("0", "c", 2, 17), ("1", "c", 2, 17), ("2", "c", 2, 16)]
    for packed in (bt.pack_batches(df), split):
        back = bt.unpack_batches(packed)
        assert rows(back, "event", "seq", "name", "object") == sorted(
            ((e, s, n, o) for _, _, e, s, n, o in data if e != "Other"), key=repr
        )
    order = bt.unpack_batches(bt.pack_batches(df)).orderBy("op_rank", "pos").select("event").collect()
    assert [r.event for r in order[::10]] == events


def test_unpack_reconciliation(spark):
    body = {"account": "a", "cluster": "c", "msgId": "m", "kindToObject": {
        "g/v1/r": [{"checksum": "k", "resourceVersion": 3, "name": "n", "namespace": "s"}], "bad": [{"name": "x"}], "/v1/pods": []}}
    df = spark.createDataFrame([(json.dumps(body),)], "payload string")
    good, bad = bt.unpack_reconciliation(df)
    assert rows(good, "kind", "ns", "name", "version", "checksum", "batch_type") == [("g/v1/r", "s", "n", 3, "k", "reconciliation")]
    assert rows(bad, "kind", "n_objects") == [("bad", 1)]


def test_dispatch(spark):
    df = spark.createDataFrame([("", 1), ("reconciliation", 2), ("odd", 3), (None, 4)], "batch_type string, n int")
    handlers = {"": lambda d: d.withColumn("by", F.lit("default")), "reconciliation": lambda d: d.withColumn("by", F.lit("rec"))}
    handled, rejected = bt.dispatch_batches(df, handlers)
    assert rows(handled, "n", "by") == [(1, "default"), (2, "rec")]
    assert rows(rejected, "n") == [(3,), (4,)]
    with pytest.raises(ValueError):
        bt.dispatch_batches(df, {})


def test_reports_and_requests(spark):
    data = [("s1", "t", "a", f"c{i}") for i in range(25)] + [("s2", "t", "a", "x")]
    df = spark.createDataFrame(data, "server string, tick string, account string, cluster string")
    reports = cl.connected_report(df, max_clients=10)
    assert reports.where("server = 's1'").count() > 1
    assert reports.groupBy("server").agg(F.sum("n_clients").alias("n")).where("server = 's1'").first()["n"] == 25
    assert cl.connected_report(df).where("server = 's1'").first()["n_clients"] == 25
    assert cl.request_batch(df).first()["n_requests"] == 26
    assert cl.request_batch(df.where("server = 'none'")).count() == 0
    assert cl.request_messages(df).count() == 26


def test_routing(spark):
    sent = spark.createDataFrame([("a", "c", 1), ("a", "x", 2), (None, "c", 3)], "account string, cluster string, n int")
    live = spark.createDataFrame([("a", "c"), ("a", "c")], "account string, cluster string")
    assert rows(cl.route_to_connected(sent, live), "n") == [(1,)]


def test_metrics(spark):
    df = spark.createDataFrame([("success", "GetObject", "r", "a", "c", "é"), ("success", "GetObject", "r", "a", "c", None)],
                               "status string, event_type string, kind string, account string, cluster string, payload string")
    assert rows(msg.message_metrics(df), "n_messages", "payload_bytes") == [(2, 2)]


def test_kafka_columns(spark):
    row = io.as_kafka(msg.envelope(wide(spark, "GetObject"), "own")).first()
    assert {h["key"]: bytes(h["value"]).decode() for h in row.headers}["event"] == "GetObject"
    assert row.key == "own" and json.loads(row.value)["name"] == "n"


def test_cluster_wide_objects_have_an_empty_namespace(spark):
    body = {"Event": 0, "Name": "node", "Kind": {"Group": "", "Version": "v1", "Resource": "nodes"}}
    assert socket(spark, body).first().ns == ""
    log = spark.createDataFrame([("VerifyObject", '{"kind":"/v1/nodes","name":"node"}')], "event string, payload string")
    assert msg.decode_log_messages(log).first().ns == ""
