import json
import random

import pytest
from tests.helpers import compact, merge_patch, random_json, without_nulls
from pyspark.sql import functions as F

from lockstep.functions import documents as docs
from lockstep.functions import trees
from lockstep.operators import paths

ONE = '{"kind":"kind","metadata":{"name":"name","resourceVersion":"1"}}'
TWO = '{"kind":"kind","metadata":{"name":"name","resourceVersion":"2"}}'


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return df.select(expr.alias("r")).first()["r"]


def test_random_documents(spark):
    rng = random.Random(11)
    pairs = []
    for i in range(1500):
        a = random_json(rng, 3) if rng.random() < 0.1 else {k: random_json(rng, 3) for k in "abc" if rng.random() < 0.7}
        if rng.random() < 0.5:
            b = merge_patch(a, random_json(rng, 3))
        else:
            b = random_json(rng, 3) if rng.random() < 0.1 else {k: random_json(rng, 3) for k in "abc" if rng.random() < 0.7}
        pairs.append((i, json.dumps(a), json.dumps(b)))
    df = (
        spark.createDataFrame(pairs, "i int, a string, b string")
        .withColumns({"la": docs.leaves("a"), "lb": docs.leaves("b")})
        .withColumns({"round_trip": docs.leaves_to_json("la"), "canonical": docs.canonical("a")})
        .withColumns({"change": docs.diff("la", "lb")})
        .withColumns(
            {
                "patch": docs.leaves_to_json("change"),
                "patched": F.expr(trees.to_json(trees.patch("la", "change"))),
                "merged": F.expr(trees.to_json(trees.patch("la", "lb"))),
            }
        )
    )
    for row in df.collect():
        a, b = json.loads(row.a), json.loads(row.b)
        assert json.loads(row.round_trip) == a
        assert row.round_trip == row.canonical
        # any document is a merge patch for any other
        assert json.loads(row.merged) == merge_patch(a, b), (row.a, row.b)
        if row.patch is None:
            assert without_nulls(a) == without_nulls(b)
            continue
        # the patch means the same to any reader, and leads to the new document
        assert json.loads(row.patched) == merge_patch(a, json.loads(row.patch)), (row.a, row.b, row.patch)
        assert without_nulls(json.loads(row.patched)) == without_nulls(b), (row.a, row.b, row.patch)


def test_golden_patch(spark):
    change = F.expr(trees.to_json(trees.diff(trees.leaves("a"), trees.leaves("b"))))
    assert one(spark, change, a=ONE, b=TWO) == '{"metadata":{"resourceVersion":"2"}}'


def test_removed_subtree_is_one_null(spark):
    change = F.expr(trees.to_json(trees.diff(trees.leaves("a"), trees.leaves("b"))))
    old = '{"a":{"b":{"c":1,"d":2}},"e":1}'
    assert one(spark, change, a=old, b='{"e":1}') == '{"a":null}'
    assert one(spark, change, a=old, b='{"a":{},"e":1}') == '{"a":{"b":null}}'
    assert one(spark, change, a=old, b='{"a":{"b":5},"e":1}') == '{"a":{"b":5}}'


def test_checksum_properties(spark):
    texts = [
        ('{"a":1,"b":{"c":[1,2]}}', '{ "b" : {"c":[1, 2]}, "a":1.0 }', True),
        ('{"a":1}', '{"a":2}', False),
        ('{"a":1}', '{"a":"1"}', False),
        ('{"a":null}', "{}", False),
        ('{"a":[1,2]}', '{"a":[2,1]}', False),
    ]
    df = spark.createDataFrame(texts, "a string, b string, same boolean")
    for r in df.withColumns({"x": docs.checksum("a"), "y": docs.checksum("b"), "eq": docs.json_equal("a", "b")}).collect():
        assert (r.x == r.y) is r.same and r.eq is r.same


@pytest.mark.parametrize("text", ["not a valid json", "", '{"a":1}}', '{"a":1} x', "1,2", '{"a":1,"a":2}', "{"])
def test_invalid_json(spark, text):
    assert one(spark, docs.checksum("a"), a=text) is None
    assert one(spark, docs.is_valid("a"), a=text) is False
    assert one(spark, docs.json_equal("a", "a"), a=text) is False
    assert one(spark, docs.leaves("a"), a=text) is None


def test_annotation_is_the_fast_path(spark):
    assert one(spark, docs.checksum("a", "note"), a="broken", note="known") == "known"


def test_depth_is_never_cut(spark):
    deep = '{"a":{"b":{"c":{"d":1}}}}'
    very = '{"n":' * 300 + "1" + "}" * 300
    unreadable = '{"n":' * 5000 + "1" + "}" * 5000
    df = spark.createDataFrame([(deep,), ('{"text":"}}}{{{{{{"}',), (very,), (unreadable,), ("{}",), ("7",)], "doc string")
    found = paths.to_path_rows(df.withColumn("k", F.lit(1)), ["k"])
    assert {r.path for r in found.collect()} == {"/a/b/c/d", "/text", "/n" * 300, ""}
    back = df.select(docs.leaves("doc").alias("tree")).select(docs.leaves_to_json("tree").alias("back"))
    assert [r.back for r in back.collect()] == [deep, '{"text":"}}}{{{{{{"}', very, None, "{}", "7"]


def test_rows_checksum_equals_document_checksum(spark):
    rng = random.Random(3)
    data = [(str(i), json.dumps({"x": random_json(rng, 3), "y": random_json(rng, 2)})) for i in range(200)]
    df = spark.createDataFrame(data, "k string, doc string")
    by_rows = paths.rows_checksum(paths.to_path_rows(df, ["k"]), ["k"])
    direct = df.select("k", docs.checksum("doc").alias("want"))
    assert by_rows.join(direct, "k").where("checksum <> want").count() == 0
    assert by_rows.count() == 200


def clean(spark, kind, doc):
    df = spark.createDataFrame([(kind, json.dumps(doc))], "kind string, doc string")
    return json.loads(paths.clean_objects(df).first()["doc"])


def test_clean_objects(spark):
    policy = {
        "metadata": {
            "annotations": {"kubectl.kubernetes.io/last-applied-configuration": "{}"},
            "managedFields": [{"manager": "x"}],
            "name": "p",
        }
    }
    # the emptied map stays
    assert clean(spark, "networking/v1/networkpolicies", policy) == {"metadata": {"annotations": {}, "name": "p"}}
    node = {"metadata": {"name": "n"}, "status": {"conditions": [{"type": "Ready"}], "phase": "x"}}
    cleared = clean(spark, "/v1/nodes", node)
    assert cleared["status"] == {"conditions": None, "phase": "x"}
    assert clean(spark, "/v1/pods", node) == node
    bom = {"spec": {"syft": {"descriptor": {"a": {"b": 1}}, "files": [], "artifactRelationships": 5, "rest": 1}}}
    assert clean(spark, "example.org/v1beta1/sbomsyfts", bom) == {
        "spec": {"syft": {"descriptor": None, "files": None, "artifactRelationships": None, "rest": 1}}
    }


def mask(spark, doc):
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string")
    return json.loads(paths.mask_env(df).first()["doc"])


def env(*entries):
    return [{"name": "c", "env": list(entries)}, {"name": "no env"}]


def test_mask_env(spark):
    plain, masked = {"name": "A", "value": "secret"}, {"name": "A", "value": "XXXXXX"}
    ref = {"name": "B", "valueFrom": {"secretKeyRef": {"key": "k"}}}
    spec = {"containers": env(plain, ref, "odd"), "initContainers": env(plain)}
    want = {"containers": env(masked, ref, "odd"), "initContainers": env(masked)}
    deployment = {"kind": "Deployment", "spec": {"template": {"spec": spec}}}
    assert mask(spark, deployment) == {"kind": "Deployment", "spec": {"template": {"spec": want}}}
    cron = {"kind": "CronJob", "spec": {"jobTemplate": {"spec": {"template": {"spec": spec}}}}}
    assert mask(spark, cron)["spec"]["jobTemplate"]["spec"]["template"]["spec"] == want
    pod = {"kind": "Pod", "spec": {"ephemeralContainers": env(plain)}}
    assert mask(spark, pod)["spec"] == {"ephemeralContainers": env(masked)}
    for untouched in (
        {"kind": "Service", "spec": {"containers": env(plain)}},
        {"kind": "Pod", "spec": {"containers": [{"name": "c", "env": "no list"}, "odd"]}},
        {"kind": "Pod", "spec": {"containers": "no list"}},
        {"kind": "Pod"},
    ):
        assert mask(spark, untouched) == untouched


def test_merge_metadata(spark):
    old = {"metadata": {"resourceVersion": "2", "uid": "u", "labels": {"a": "old"}, "annotations": {}}, "spec": 1}
    new = {"metadata": {"resourceVersion": "1", "labels": {"a": "new", "b": "x"}, "annotations": {"g": "1"}}, "spec": 2}
    merged = json.loads(one(spark, docs.merge_metadata("a", "b"), a=json.dumps(old), b=json.dumps(new)))
    assert merged == {
        "metadata": {
            "resourceVersion": "2",
            "uid": "u",
            "labels": {"a": "old", "b": "x"},
            "annotations": {"g": "1"},
        },
        "spec": 2,
    }


def test_diff_of_equal_documents_is_empty(spark):
    df = spark.createDataFrame([("k", ONE)], "k string, doc string")
    assert paths.diff_rows(df, df, ["k"]).count() == 0
    assert compact(json.loads(ONE)) == one(spark, docs.canonical("a"), a=ONE)
