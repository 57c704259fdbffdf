import json
import random

import pytest
from pyspark.sql import functions as F

from lockstep.cluster import lookup
from lockstep.functions import documents as docs
from lockstep.model import KINDS_SCHEMA
from lockstep.operators import store as st
from lockstep.operators.batches import pack_batches
from tests.helpers import compact, merge_patch, rows

KIND = "apps/v1/deployments"
STORE = "kind string, ns string, name string, version string, doc string"


def doc(version, **spec):
    return compact({"metadata": {"resourceVersion": str(version)}, "spec": spec})


def store(spark, objects):
    data = [(KIND, "ns", n, json.loads(d).get("metadata", {}).get("resourceVersion") if d.startswith("{") else None, d)
            for n, d in objects.items()]
    return spark.createDataFrame(data, STORE)


def kinds(spark, strategy="patch"):
    return lookup(spark, [(KIND, strategy)], KINDS_SCHEMA)


def digest(spark, text):
    return spark.range(1).select(docs.checksum(f"'{text}'").alias("c")).first()["c"]


def test_put_or_patch(spark):
    old, new = doc(1, a=1), doc(2, a=2)
    fresh = store(spark, {"x": new})
    known = store(spark, {"x": old})
    nothing = known.where(F.lit(False))
    assert rows(st.put_or_patch(fresh, known, kinds(spark, "copy")), "event", "object") == [("PutObject", new)]
    assert rows(st.put_or_patch(fresh, nothing, kinds(spark)), "event", "object") == [("PutObject", new)]
    sent = st.put_or_patch(fresh, known, kinds(spark)).first()
    assert (sent.event, sent.patch) == ("PatchObject", '{"metadata":{"resourceVersion":"2"},"spec":{"a":2}}')
    assert sent.checksum == digest(spark, new)
    # a base that came along overrides the known state
    other = st.put_or_patch(fresh.withColumn("base_object", F.lit(doc(2, a=1))), known, kinds(spark)).first()
    assert other.patch == '{"spec":{"a":2}}'
    # only the version moved: nothing is sent; nothing moved: an empty patch
    assert st.put_or_patch(store(spark, {"x": doc(2, a=1)}), known, kinds(spark)).count() == 0
    assert st.put_or_patch(known, known, kinds(spark)).first().patch == "{}"


def test_advance_known(spark):
    known, sent = store(spark, {"x": doc(1), "y": doc(1)}), store(spark, {"x": doc(2), "z": doc(3)})
    assert rows(st.advance_known(known, sent), "name", "doc") == [("x", doc(2)), ("y", doc(1)), ("z", doc(3))]


def test_serve_gets(spark):
    held = store(spark, {"x": doc(2, a=2)})
    asked = spark.createDataFrame(
        [(KIND, "ns", "x", None), (KIND, "ns", "nowhere", None)], "kind string, ns string, name string, base_object string"
    )
    nothing = held.where(F.lit(False))
    answers, errors = st.serve_gets(asked, held, nothing, kinds(spark))
    assert rows(answers, "name", "event", "object") == [("x", "PutObject", doc(2, a=2))]
    assert rows(errors, "name", "error") == [("nowhere", "object not found")]
    based = asked.withColumn("base_object", F.lit(doc(1, a=1)))
    answers, _ = st.serve_gets(based, held, nothing, kinds(spark))
    assert rows(answers, "event", "patch") == [("PatchObject", '{"metadata":{"resourceVersion":"2"},"spec":{"a":2}}')]
    answers, _ = st.serve_gets(based, held, nothing, kinds(spark, "copy"))
    assert rows(answers, "event") == [("PutObject",)]


def patches(spark, *messages):
    return spark.createDataFrame(
        [(KIND, "ns", n, c, p) for n, c, p in messages], "kind string, ns string, name string, checksum string, patch string"
    )


def test_apply_patches(spark):
    held = store(spark, {"x": doc(1, a=1)})
    good = digest(spark, doc(1, a=5))
    change = '{"spec":{"a":5}}'
    done = st.apply_patches(patches(spark, ("x", good, change)), held, kinds(spark)).first()
    assert (done.outcome, done.doc) == ("stored", doc(1, a=5))
    for message, base in (
        (("nowhere", good, change), None),
        (("x", good, "not a patch"), doc(1, a=1)),
        (("x", "wrong", change), doc(1, a=1)),
    ):
        done = st.apply_patches(patches(spark, message), held, kinds(spark)).first()
        assert (done.outcome, done.base_object) == ("get", base)
    done = st.apply_patches(patches(spark, ("x", good, change)), held, kinds(spark, "copy")).first()
    assert (done.outcome, done.base_object) == ("get", None)


def test_verify(spark):
    held = store(spark, {"same": doc(1), "off": doc(1), "bad": "not json"})
    sent = spark.createDataFrame(
        [(KIND, "ns", n, digest(spark, doc(1)) if n == "same" else "x") for n in ("same", "off", "bad", "new")],
        "kind string, ns string, name string, checksum string",
    )
    assert rows(st.verify(sent, held), "name", "reason", "base_object") == [
        ("bad", "unreadable", None),
        ("new", "missing", None),
        ("off", "mismatch", doc(1)),
    ]


def test_save_if_newer(spark):
    cases = {"newer": (doc(1), doc(2)), "same": (doc(1, a=1), doc(1, a=2)), "older": (doc(2), doc(1)),
             "text": (doc("x"), doc(9)), "bad old": ("broken", doc(1)), "bad new": (doc(1), "broken")}
    held = store(spark, {k: v[0] for k, v in cases.items()} | {"kept": doc(1)})
    puts = store(spark, {k: v[1] for k, v in cases.items()} | {"fresh": doc(1)})
    got = dict(rows(st.save_if_newer(held, puts), "name", "doc"))
    assert got == {"newer": doc(2), "same": doc(1, a=1), "older": doc(2), "text": doc("x"), "bad old": doc(1),
                   "bad new": "broken", "kept": doc(1), "fresh": doc(1)}
    again = st.save_if_newer(st.save_if_newer(held, puts), puts)
    assert dict(rows(again.where("name not like 'bad%'"), "name", "doc")) == {
        k: v for k, v in got.items() if not k.startswith("bad")
    }
    always = dict(rows(st.save_if_newer(held, puts, check=False), "name", "doc"))
    assert always["older"] == doc(1) and always["text"] == doc(9)


def test_resolve_conflicts(spark):
    a = store(spark, {"tie": doc(1, side="a"), "a": doc(2), "only": doc(1), "text": doc("x")})
    b = store(spark, {"tie": doc(1, side="b"), "a": doc(1), "text": doc("y")})
    assert dict(rows(st.resolve_conflicts(a, b), "name", "origin")) == {
        "tie": "backend", "a": "cluster", "only": "cluster", "text": "backend",
    }


def test_apply_changes(spark):
    held = store(spark, {"x": doc(1), "gone": doc(1), "kept": doc(1)})
    changes = spark.createDataFrame(
        [("x", "put", doc(2), 1), ("x", "put", doc(3), 2), ("gone", "put", doc(5), 1), ("gone", "delete", None, 2),
         ("new", "put", doc(1), 1), ("never", "delete", None, 1)],
        "name string, op string, doc string, seq int",
    ).withColumns({"kind": F.lit(KIND), "ns": F.lit("ns"), "version": F.lit("0")})
    assert dict(rows(st.apply_changes(held, changes), "name", "doc")) == {"x": doc(3), "kept": doc(1), "new": doc(1)}


def test_apply_changes_can_keep_metadata(spark):
    held = store(spark, {"x": '{"metadata":{"resourceVersion":"7","labels":{"a":"1"}},"spec":1}'})
    changes = store(spark, {"x": '{"metadata":{"resourceVersion":"1","labels":{"a":"2","b":"3"}},"spec":2}'})
    changes = changes.withColumns({"op": F.lit("put"), "seq": F.lit(1)})
    got = json.loads(st.apply_changes(held, changes, keep_metadata=True).first()["doc"])
    assert got == {"metadata": {"resourceVersion": "7", "labels": {"a": "1", "b": "3"}}, "spec": 2}


def model_replay(objects, messages, check, digest_of):
    """Message by message, as a store would do it."""
    objects, asked = dict(objects), []

    def version(d):
        v = json.loads(d).get("metadata", {}).get("resourceVersion", "")
        return int(v) if v.lstrip("-").isdigit() else None

    def save(name, new):
        old = objects.get(name)
        if check and old is not None:
            a, b = version(new), version(old)
            if a is None or b is None or a <= b:
                return
        objects[name] = new

    for name, seq, event, checksum, patch, obj in sorted(messages, key=lambda m: m[1]):
        held = objects.get(name)
        if event == "DeleteObject":
            objects.pop(name, None)
        elif event == "PutObject":
            save(name, obj)
        elif event == "VerifyObject":
            if held is None or digest_of(held) != checksum:
                asked.append((name, seq, held))
        else:
            merged = None if held is None else compact(merge_patch(json.loads(held), json.loads(patch)))
            if merged is None or digest_of(merged) != checksum:
                asked.append((name, seq, held))
            else:
                save(name, merged)
    return objects, asked


@pytest.mark.parametrize("check, per_round", [(True, 3), (False, 3), (True, 256)])
def test_replay_equals_message_by_message(spark, check, per_round):
    import hashlib

    def digest_of(d):
        return hashlib.sha256(d.encode()).hexdigest()

    rng = random.Random(7)
    objects = {str(k): doc(1, a=k) for k in range(8)}
    messages, shadow = [], dict(objects)
    for seq in range(120):
        name = "0" if rng.random() < 0.35 else str(rng.randint(1, 11))  # one hot key
        event = rng.choice(["PatchObject"] * 4 + ["PutObject", "VerifyObject", "DeleteObject"])
        version = seq if rng.random() < 0.8 else 0
        checksum = patch = obj = None
        if event == "PatchObject":
            change = {"metadata": {"resourceVersion": str(version)}, "spec": {rng.choice("abc"): rng.choice([None, seq, {}])}}
            patch = compact(change)
            base = shadow.get(name)
            merged = compact(merge_patch(json.loads(base), change)) if base else "x"
            checksum = digest_of(merged) if rng.random() < 0.8 else "wrong"
            if base and checksum != "wrong":
                shadow[name] = merged
        elif event == "PutObject":
            obj = doc(version, p=seq)
            shadow[name] = obj
        elif event == "VerifyObject":
            checksum = digest_of(shadow[name]) if name in shadow and rng.random() < 0.7 else "wrong"
        else:
            shadow.pop(name, None)
        messages.append((name, seq, event, checksum, patch, obj))
    df = spark.createDataFrame(
        messages, "name string, seq bigint, event string, checksum string, patch string, object string"
    ).withColumns({"kind": F.lit(KIND), "ns": F.lit("ns")}).repartition(4)
    after, asked, _ = st.replay(store(spark, objects), df, check, per_round=per_round)
    want_objects, want_asked = model_replay(objects, messages, check, digest_of)
    assert dict(rows(after, "name", "doc")) == want_objects
    assert rows(asked, "name", "seq", "base_object") == sorted(want_asked, key=repr)


def put(name, version, seq, batch=0, **spec):
    return (batch, KIND, "", "ns", name, "PutObject", None, doc(version, **spec), seq)


def gone(name, seq, batch=0):
    return (batch, KIND, "", "ns", name, "DeleteObject", None, None, seq)


MESSAGES = "batch long, kind string, batch_type string, ns string, name string, event string, checksum string, object string, seq bigint"


def test_one_batch_ends_before_the_next(spark):
    sent = [put("a", 1, 0), gone("a", 1, batch=1), gone("b", 2), put("b", 7, 3, batch=1, b=1), put("b", 2, 4, batch=1, b=2)]
    packed = pack_batches(spark.createDataFrame(sent, MESSAGES), by=["batch"])
    held = store(spark, {"b": doc(9)})
    done = st.fold_batches(held, packed, kinds(spark), order="batch")
    assert rows(done.store, "name", "doc") == [("b", doc(7, b=1))]


def test_versions_that_are_no_numbers_change_nothing_until_one_is(spark):
    sent = [put("a", "abc", 0, x=1), put("a", 9, 1, x=2)]
    done = st.fold_batches(store(spark, {"a": doc(5)}), pack_batches(spark.createDataFrame(sent, MESSAGES)), kinds(spark))
    assert rows(done.store, "name", "version", "doc") == [("a", "9", doc(9, x=2))]


def test_events_of_one_place_are_all_replayed(spark):
    sent = spark.createDataFrame([put("a", v, 0) for v in range(1, 6)] + [put("b", 1, 0)], MESSAGES)
    after, _, _ = st.replay(store(spark, {}), sent, per_round=2)
    assert rows(after, "name", "version") == [("a", "5"), ("b", "1")]


def test_replay_as_a_cluster_does(spark):
    kept = compact({"metadata": {"labels": {"l": "old"}, "resourceVersion": "5", "uid": "u"}, "spec": {"a": 1}})
    new = compact({"metadata": {"labels": {"l": "new", "m": "1"}, "resourceVersion": "3"}, "spec": {"a": 2}})
    held = store(spark, {"a": kept, "p": doc(1)})
    sent = spark.createDataFrame(
        [("PutObject", "a", None, new, None, 0), ("PatchObject", "p", "x", None, "{}", 1), ("GetObject", "p", None, None, None, 2)],
        "event string, name string, checksum string, object string, patch string, seq bigint",
    ).withColumns({"kind": F.lit(KIND), "ns": F.lit("ns")})
    after, asked, found = st.replay(held, sent, check=False, kinds=kinds(spark, "copy"), keep_metadata=True)
    merged = compact({"metadata": {"labels": {"l": "old", "m": "1"}, "resourceVersion": "5", "uid": "u"}, "spec": {"a": 2}})
    assert rows(after, "name", "doc") == [("a", merged), ("p", doc(1))]
    # the kind is not patched: the object is asked for without base
    assert rows(asked, "name", "base_object") == [("p", None)]
    assert rows(found, "name", "doc") == [("p", doc(1))]


def test_fold_batches(spark):
    held = store(spark, {"x": doc(1, a=1), "del": doc(1), "p": doc(1, a=1)})
    good = digest(spark, doc(2, a=2))
    items = [
        ("x", "GetObject", None, None, None, None),
        ("x", "VerifyObject", "wrong", None, None, None),
        ("new", "VerifyObject", "x", None, None, None),
        ("del", "DeleteObject", None, None, None, None),
        ("del", "PatchObject", "x", "{}", None, None),
        ("p", "PatchObject", good, '{"metadata":{"resourceVersion":"2"},"spec":{"a":2}}', None, None),
        ("put", "PutObject", None, None, doc(3), "3"),
        ("x", "PutObject", None, None, doc(1, a=9), "1"),
    ]
    messages = spark.createDataFrame(
        [(KIND, "", "ns", *i, n) for n, i in enumerate(items)],
        "kind string, batch_type string, ns string, name string, event string, checksum string, patch string, "
        "object string, version string, seq bigint",
    )
    done = st.fold_batches(held, pack_batches(messages), kinds(spark))
    assert dict(rows(done.store, "name", "doc")) == {"x": doc(1, a=1), "p": doc(2, a=2), "put": doc(3)}
    assert rows(done.requests, "name", "base_object") == [("del", None), ("new", None), ("x", doc(1, a=1))]
    assert rows(done.answers, "name", "event") == [("x", "PutObject")]
    assert done.errors.count() == 0


CLIENTS = "account string, cluster string, " + STORE


def test_clients_that_share_names_are_kept_apart(spark):
    held = spark.createDataFrame([("a", c, KIND, "ns", "x", v, doc(v, of=c)) for c, v in (("c1", "5"), ("c2", "7"))], CLIENTS)
    put = spark.createDataFrame([("a", "c1", KIND, "ns", "x", "9", doc(9, of="c1", n=1))], CLIENTS)
    want = [("c1", "9"), ("c2", "7")]
    assert rows(st.save_if_newer(held, put), "cluster", "version") == want
    changes = put.withColumns({"op": F.lit("put"), "seq": F.lit(1)})
    assert rows(st.apply_changes(held, changes), "cluster", "version") == want
    gone = changes.withColumn("op", F.lit("delete"))
    assert rows(st.apply_changes(held, gone), "cluster", "version") == [("c2", "7")]
    asked = held.select("account", "cluster", "kind", "ns", "name", F.lit("off").alias("checksum"))
    assert rows(st.verify(asked, held), "cluster", "base_object") == [("c1", doc("5", of="c1")), ("c2", doc("7", of="c2"))]
    assert rows(st.advance_known(held, put), "cluster", "doc") == [("c1", doc(9, of="c1", n=1)), ("c2", doc("7", of="c2"))]
    assert rows(st.resolve_conflicts(put, held), "cluster", "version", "origin") == [("c1", "9", "cluster"), ("c2", "7", "backend")]
    answers, errors = st.serve_gets(asked.drop("checksum"), held, held, kinds(spark))
    assert rows(answers, "cluster", "patch") == [("c1", "{}"), ("c2", "{}")] and errors.count() == 0
    sent = st.put_or_patch(put, held, kinds(spark))
    assert rows(sent, "cluster", "event") == [("c1", "PatchObject")]
    after = st.apply_patches(sent, held, kinds(spark))
    assert rows(after, "cluster", "outcome", "doc") == [("c1", "stored", doc(9, of="c1", n=1))]


def test_rows_without_client_cannot_meet_a_store_of_clients(spark):
    held = spark.createDataFrame([("a", "c1", KIND, "ns", "x", "5", doc(5))], CLIENTS)
    for call in (st.verify, st.save_if_newer, st.apply_changes, st.advance_known):
        with pytest.raises(ValueError, match="account, cluster missing"):
            call(store(spark, {"x": doc(6)}), held) if call is st.verify else call(held, store(spark, {"x": doc(6)}))
