from pyspark.sql import functions as F

from lockstep.functions import identity as ident


def test_kinds(spark):
    df = spark.createDataFrame([("apps/v1/deployments",), ("/v1/pods",), ("a/b",), ("a/b/c/d",), ("",), (None,)], "t string")
    got = [r.k for r in df.select(ident.parse_kind(F.col("t")).alias("k")).collect()]
    assert [tuple(k) if k else None for k in got] == [
        ("apps", "v1", "deployments"), ("", "v1", "pods"), None, None, None, None,
    ]
    back = df.where("t like '%/v1/%'").select(
        F.col("t"), ident.parse_kind(F.col("t")).alias("k")
    ).select("t", ident.kind_text(F.col("k.group"), F.col("k.version"), F.col("k.resource")).alias("b"))
    assert back.where("t <> b").count() == 0


def test_keys(spark):
    df = spark.createDataFrame(
        [("apps/v1/deployments", "namespace", "name"), (None, "namespace", "name"), ("/v1/nodes", None, "n")],
        "kind string, ns string, name string",
    )
    got = [r.k for r in df.select(ident.object_key(F.col("kind"), F.col("ns"), F.col("name")).alias("k")).collect()]
    assert got == ["apps/v1/deployments/namespace/name", "/namespace/name", "/v1/nodes//n"]
    row = spark.range(1).select(
        ident.client_key(F.lit("account"), F.lit("cluster")).alias("c"),
        ident.connection_key(F.lit("account"), F.lit("cluster"), F.lit("id")).alias("n"),
        ident.event_key(F.lit(""), F.lit(""), F.lit("Pod"), F.lit(""), F.lit("")).alias("e"),
    ).first()
    assert tuple(row) == ("account/cluster", "account/cluster/id", "//Pod//")


def test_versions(spark):
    cases = [("5", 5), ("-3", -3), ("+4", 4), (" 5 ", 0), ("5\n", 0), ("1.0", 0), ("", 0), (None, 0), ("9" * 30, 0)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r.v for r in df.select(ident.to_version(F.col("t")).alias("v")).collect()] == [v for _, v in cases]
    newer = [("2", "1", True), ("1", "1", False), ("1", "2", False), ("x", "1", False), ("2", "", False), (None, "1", False)]
    df = spark.createDataFrame([n[:2] for n in newer], "a string, b string")
    got = [r.n for r in df.select(ident.version_newer(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [n[2] for n in newer]


def test_semver(spark):
    order = ["v0.0.1", "v0.0.2", "v0.1.0-1", "v0.1.0-2", "v0.1.0-10", "v0.1.0-alpha", "v0.1.0-alpha.1", "v0.1.0-beta",
             "v0.1.0", "v0.2", "v1", "v1.2.3", "v1.10.0"]
    pairs = [(a, b, i >= j) for i, a in enumerate(order) for j, b in enumerate(order)]
    pairs += [("junk", "v0.0.1", False), ("v0.0.1", "junk", True), ("junk", "0.0.1", True), ("v1.0.0+x", "v1.0.0", True),
              ("v1", "v1.0.0", True), ("v01.0.0", "v0.0.0", False), (None, "v0.0.1", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    bad = df.where(ident.semver_ge(F.col("a"), F.col("b")) != F.col("want"))
    assert bad.collect() == []


def test_batch_support(spark):
    cases = {"": False, "v0.0.56": False, "v0.0.57": True, "v0.0.58": True, "v1.0.0": True, "v1.2.3": True,
             "invalid_version": False}
    df = spark.createDataFrame(list(cases.items()) + [(None, False)], "v string, want boolean")
    assert df.where(ident.supports_batch(F.col("v")) != F.col("want")).count() == 0


def test_identity_from_object(spark):
    docs = [
        ('{"apiVersion":"Apps/V1","kind":"Deployment","metadata":{"name":"N","namespace":"NS","resourceVersion":"7"}}',
         ("apps", "v1", "deployment", "ns", "n", 7)),
        ('{"apiVersion":"v1","kind":"Pod","metadata":{"name":"x"}}', ("v1", "v1", "pod", "", "x", 0)),
        ("{}", ("", "v1", "", "", "", 0)),
        ("broken", None),
    ]
    df = spark.createDataFrame([(d,) for d, _ in docs], "doc string")
    got = [r.i for r in df.select(ident.identity_from_object("doc").alias("i")).collect()]
    assert [tuple(i) if i else None for i in got] == [want for _, want in docs]


def test_lineage(spark):
    df = spark.createDataFrame([(3, "m"), (None, None)], "depth int, msg_id string")
    first, second = ident.lineage(df).collect()
    assert (first.depth, first.msg_id) == (4, "m")
    assert second.depth == 1 and len(second.msg_id) == 36
