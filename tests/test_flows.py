import json

import pytest
from pyspark.sql import functions as F

from lockstep.cluster import lookup
from lockstep.functions import documents as docs
from lockstep.model import KINDS_SCHEMA
from lockstep.operators import reconcile as rec
from lockstep.operators.store import resolve_conflicts, verify
from lockstep.plans.flows import Settings, backend_to_store, cluster_to_backend, sync_round, verify_round
from tests.helpers import compact, rows
from tests.test_ordered import at

OBJECTS = "kind string, ns string, name string, version string, doc string"
DEPLOY, CONFIG, SECRET = "apps/v1/deployments", "/v1/configmaps", "/v1/secrets"


def obj(name, version, kind=DEPLOY, ns="default", **spec):
    doc = compact({"kind": kind.split("/")[-1], "metadata": {"name": name, "resourceVersion": str(version)}, "spec": spec})
    return (kind, ns, name, str(version), doc)


def table(spark, *objects):
    return spark.createDataFrame(list(objects), OBJECTS)


def kinds(spark):
    return lookup(spark, [(DEPLOY, "patch"), (CONFIG, "copy")], KINDS_SCHEMA)


def test_reconcile_three_ways(spark):
    source = table(spark, obj("same", 1), obj("newer", 2), obj("missing", 1), obj("hidden", 1, ns="kube-system"), obj("text", "x"))
    target = table(spark, obj("same", 1, other=1), obj("newer", 3), obj("extra", 1), obj("text", "y"))
    plan = rec.reconcile(source, target, scope=F.col("ns") != "kube-system", keep_skips=True)
    assert dict(rows(plan, "name", "op")) == {
        "same": "skip", "newer": "put", "missing": "verify", "hidden": "skip", "extra": "delete", "text": "skip",
    }
    with pytest.raises(ValueError, match="empty target"):
        rec.reconcile(source, target.where(F.lit(False)))
    assert rec.reconcile(source, target.where(F.lit(False)), allow_empty=True).where("op <> 'verify'").count() == 0


def test_a_second_round_has_nothing_to_do(spark):
    source = table(spark, obj("a", 1), obj("b", 2), obj("c", 3, kind=CONFIG), obj("out", 1, ns="x"))
    target = table(spark, obj("b", 1), obj("gone", 9), obj("c", 3, kind=CONFIG))
    scope = F.col("ns") != "x"
    after = sync_round(source, target, scope)
    assert rows(after, "name", "doc") == rows(source.where(scope), "name", "doc")
    assert rec.reconcile(source, after, scope).count() == 0


@pytest.mark.parametrize("strategy", ["patch", "copy"])
def test_verify_round(spark, strategy):
    source = table(spark, obj("a", 1), obj("b", 2, x=1, y={"z": 1}), obj("same", 1))
    target = table(spark, obj("b", 1, x=1, y={"q": 2}), obj("kept", 9), obj("same", 1))
    both = lookup(spark, [(DEPLOY, strategy)], KINDS_SCHEMA)
    after = verify_round(source, target, both)
    want = rows(source, "name", "doc") + [("kept", obj("kept", 9)[4])]
    assert rows(after, "name", "doc") == sorted(want)
    checks = source.select("kind", "ns", "name", docs.checksum("doc").alias("checksum"))
    # nothing is asked for twice once the checksums agree
    assert verify(checks, after).count() == 0


def test_corrupt_copies_are_replaced(spark):
    source = table(spark, obj("a", 1, x=1), obj("b", 1, x=1))
    corrupt = table(spark, ("apps/v1/deployments", "default", "a", "1", "{broken"), obj("b", 1, x=2))
    after = verify_round(source, corrupt, kinds(spark))
    assert rows(after, "name", "doc") == rows(source, "name", "doc")


def test_conflicting_changes_settle_on_the_backend(spark):
    cluster, backend = table(spark, obj("x", 2, side="cluster")), table(spark, obj("x", 2, side="backend"))
    won = resolve_conflicts(cluster, backend).drop("origin")
    for side in (cluster, backend):
        assert rows(verify_round(won, side, kinds(spark)), "doc") == [(obj("x", 2, side="backend")[4],)]


CHANGES = (
    "kind string, ns string, name string, op string, ts timestamp, seq bigint, version string, doc string, object_kind string, "
    "owners array<struct<apiVersion:string,kind:string>>, labels map<string,string>"
)
SETTINGS = Settings(own_key="backend", operator_ns="operator", exclude=("kube-system",))
SENDER = Settings(own_key="cluster", operator_ns="operator", exclude=("kube-system",))


def watch(spark, *steps):
    data = []
    for i, (op, o, second) in enumerate(steps):
        kind, ns, name, version, doc = o
        data.append((kind, ns, name, op, at(second), i, version, doc, "Deployment", [], {}))
    return spark.createDataFrame(data, CHANGES)


def clients(spark, *names):
    return spark.createDataFrame([("account", n) for n in names], "account string, cluster string")


def test_cluster_to_backend_and_into_the_store(spark):
    changes = watch(
        spark,
        ("Modified", obj("web", 1, a=1), 0),
        ("Modified", obj("web", 2, a=2), 2),  # same burst, the later one counts
        ("Modified", obj("web", 3, a=2), 60),  # only the version
        ("Modified", obj("web", 4, a=3), 120),
        ("Modified", obj("cfg", 1, kind=CONFIG, k="v"), 0),
        ("Modified", obj("s", 1, kind=SECRET), 0),  # kind not configured
        ("Modified", obj("sys", 1, ns="kube-system"), 0),
        ("Added", obj("known", 1), 0),
        ("Deleted", obj("old", 1), 0),
        ("Error", obj("x", 1), 0),
    )
    log = cluster_to_backend(changes, kinds(spark), "account", "c1", SENDER)
    sent = log.select(F.col("properties")["event"].alias("event"), F.col("properties")["name"].alias("name"), "key")
    assert rows(sent, "name", "event") == [
        ("cfg", "PutObject"), ("known", "VerifyObject"), ("old", "DeleteObject"), ("web", "PatchObject"), ("web", "PutObject"),
    ]
    store = table(spark, obj("old", 1), obj("untouched", 1))
    done = backend_to_store(log, clients(spark, "c1"), kinds(spark), store, SETTINGS)
    assert rows(done.store, "name", "doc") == sorted(
        [("web", obj("web", 4, a=3)[4]), ("cfg", obj("cfg", 1, kind=CONFIG, k="v")[4]), ("untouched", obj("untouched", 1)[4])]
    )
    asked = rows(done.requests, "name", "event", "depth", "account", "cluster")
    assert asked == [("known", "GetObject", 2, "account", "c1")]
    assert done.rejected.count() == 0
    # other clusters are not touched, nor is what this side sent itself
    other = backend_to_store(log, clients(spark, "c2"), kinds(spark), store, SETTINGS)
    assert rows(other.store, "name") == [("old",), ("untouched",)]
    own = backend_to_store(log, clients(spark, "c1"), kinds(spark), store, SENDER)
    assert rows(own.store, "name") == [("old",), ("untouched",)]


def test_masked_before_it_leaves(spark):
    spec = {"template": {"spec": {"containers": [{"name": "c", "env": [{"name": "A", "value": "secret"}]}]}}}
    doc = compact({"kind": "Deployment", "metadata": {"managedFields": [1], "name": "web", "resourceVersion": "1"}, "spec": spec})
    changes = watch(spark, ("Modified", (DEPLOY, "default", "web", "1", doc), 0))
    log = cluster_to_backend(changes, kinds(spark), "account", "c1", SENDER)
    done = backend_to_store(log, clients(spark, "c1"), kinds(spark), table(spark, obj("o", 1)), SETTINGS)
    stored = json.loads(done.store.where("name = 'web'").first()["doc"])
    assert "managedFields" not in stored["metadata"]
    assert stored["spec"]["template"]["spec"]["containers"][0]["env"] == [{"name": "A", "value": "XXXXXX"}]


def test_guards_on_the_way_out(spark):
    changes = watch(spark, ("Modified", obj("big", 1, text="x" * 500), 0), ("Modified", obj("small", 1), 0))
    limited = Settings(own_key="cluster", max_bytes=300)
    log = cluster_to_backend(changes, kinds(spark), "account", "c1", limited)
    assert [r[0] for r in log.select(F.col("properties")["name"]).collect()] == ["small"]


def test_scope_comes_from_the_document_and_cannot_be_skipped(spark):
    def pod(name, ns, **metadata):
        doc = compact({"kind": "Pod", "metadata": {"name": name, "resourceVersion": "1"} | metadata})
        return ("v1/pods", ns, name, "1", doc)

    changes = watch(
        spark,
        ("Modified", pod("free", "default"), 0),
        ("Modified", pod("owned", "default", ownerReferences=[{"apiVersion": "apps/v1"}]), 0),
        ("Modified", pod("hashed", "default", labels={"pod-template-hash": "x"}), 0),
        ("Modified", pod("excluded", "kube-system"), 0),
        ("Modified", pod("mine", "operator", ownerReferences=[{"apiVersion": "apps/v1"}]), 0),
        ("Deleted", ("v1/pods", "default", "gone", "1", None), 0),
    )
    both = lookup(spark, [("v1/pods", "copy")], KINDS_SCHEMA)
    limited = Settings(own_key="cluster", operator_ns="operator", exclude=("kube-system",))
    changes = changes.drop("object_kind", "owners", "labels")
    log = cluster_to_backend(changes, both, "account", "c1", limited)
    assert sorted(r[0] for r in log.select(F.col("properties")["name"]).collect()) == ["free", "gone", "mine"]


def test_replay_replaces_a_corrupt_stored_object(spark):
    fresh = obj("web", 9, a=1)
    changes = watch(spark, ("Modified", fresh, 0))
    log = cluster_to_backend(changes, kinds(spark), "account", "c1", SENDER)
    store = table(spark, (DEPLOY, "default", "web", "1", "{broken"))
    done = backend_to_store(log, clients(spark, "c1"), kinds(spark), store, SETTINGS)
    assert rows(done.store, "name", "doc") == [("web", fresh[4])]
