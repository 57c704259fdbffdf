import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.llm import common, embeddings, sharding, warc
from tests.llm.plain import awkward, documents, groups, rows_by_id


def winner(key, count, weights=None):
    text = "null" if key is None else f"={key}"
    weights = weights or [1.0] * count

    def time(s):
        u = (int(hashlib.md5(f"{s}{text}".encode()).hexdigest()[: sharding.DIGITS], 16) + 0.5) / 16**sharding.DIGITS
        return -math.log(u) / weights[s]

    return min(range(count), key=time)


def test_sharded_documents(spark):
    rows = awkward() + [(100 + i, "x" * i, "en", "s", 0) for i in range(300)] + [(None, None, None, None, None), (1, "again", "en", "s", 0)]
    got = sharding.sharded_documents(documents(spark, rows).withColumn("slot", F.lit(9))).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    for r in got:
        assert r.law == "key" and r.shard == winner(r.doc_id, 8) and r.grown_shard == winner(r.doc_id, 9)
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.sharded_documents(documents(spark, [])).count() == 0


def test_weights_give_shares(spark):
    df = spark.range(4000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s"))
    assert 0.72 < df.agg(F.avg("s")).first()[0] < 0.78
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [1.0, 0.0])


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id").repartition(7)
    got = common.numbered(df, ["g"], ["k", "id"], "at").collect()
    for g in range(3):
        ordered = sorted((r for r in got if r.g == g), key=lambda r: (r.k, r.id))
        assert [r["at"] for r in ordered] == list(range(len(ordered)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 300), (300, 250), (7, 7), (400 + 1, 400)] + [(500, 501 + i) for i in range(40)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != 7 or True}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = []
    for i in range(160):
        v = centre[i % 6] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], i % 6 // 3))
    rows += [(900, [0.0] * 16, 1), (901, None, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 0)]
    rows += [(904, rows[0][1], None), (905, [1e30] * 16, 0), (906, [2e30] * 16, 0), (907, [1.0, 2.0], 0), (908, [-0.0, 2.0], 0), (909, [0.0, 2.0], 0)]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(embeddings.links, "__defaults__", (embeddings.THRESHOLD, 16))
    rows = vectors()
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").withColumn("rep", F.lit(1))
    got = rows_by_id(embeddings.near_vectors(df), "vec_id")

    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    used = [(i, np.float32(v).astype(float) if kind == "float" else np.array(v), k) for i, v, k in rows if good(v) and k is not None]
    pairs = []
    for i, v, k in used:
        for j, w, m in used:
            if i < j and k == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                pairs.append((i, j))
    parts = groups([r[0] for r in rows], pairs)
    assert len(pairs) > 50
    for i, *_ in rows:
        assert got[i]["n_links"] == sum(i in p for p in pairs)
        assert got[i]["component_id"] == parts[i] and got[i]["kept"] == (parts[i] == i)


def test_quantised_bound_is_rigorous():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 2100))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, stands, rest = embeddings.quantise(x)
    product = embeddings.code_products(codes, codes) * scale[:, None] * scale[None, :]
    assert (embeddings.code_products(codes, codes) == codes.astype(int) @ codes.astype(int).T).all()
    bound = stands[:, None] * rest[None, :] + rest[:, None] * (stands + rest)[None, :]
    assert (np.abs(x @ x.T - product) <= bound + 1e-12).all()


def test_no_vectors(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def pages(spark):
    body = "<html>" + "é" * 600 + "</html>"
    rows = [(3, "http://a/\r\nX: y", body), (9, None, body), (5, "http://c", body), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", body + " "), (None, "u", body)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows


def test_archived_pages(spark):
    df, rows = pages(spark)
    got = warc.archived_pages(df.withColumn("payload", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = next((h or "") for i, _, h in rows if i == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = r.page_id in (3, 5, None)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_records_and_damage(spark, tmp_path):
    df, rows = pages(spark)
    path = str(tmp_path / "archive")
    warc.archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})
    records = {r.page_id: bytes(r.record) for r in warc.stored_records(spark, path).collect()}
    head, _, rest = records[7].partition(b"\r\n\r\n")
    size = int(next(line.split(b": ")[1] for line in head.split(b"\r\n") if line.startswith(b"Content-Length")))
    assert rest[:size].decode() == rows[7][2] and rest[size:] == b"\r\n\r\n"
    assert b"X: y" not in head and records[3].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    broken = str(tmp_path / "broken")
    spark.read.parquet(f"{path}/records").write.parquet(f"{broken}/records")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{broken}/payloads")
    with pytest.raises(Exception, match="damaged or missing payload"):
        warc.reconstruct(spark, broken).collect()


def test_vectors_of_extreme_scale():
    x = np.array([[1e-170, 2e-170, 0.0], [1e160, 2e160, 0.0], [5e-324, 1e-323, 0.0], [0.0, 0.0, 1e300]])
    i, j = embeddings.close_pairs(x, x, embeddings.THRESHOLD)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted([(a, b) for a in range(3) for b in range(3)] + [(3, 3)])


def test_revisits_carry_the_digest_of_their_own_block(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * 2000) for i in range(3)], "page_id bigint, url string, html string")
    warc.archive(pages, str(tmp_path / "a"))
    for r in spark.read.parquet(str(tmp_path / "a" / "records")).collect():
        block = b"" if r.record_type == "revisit" else b"x" * 2000
        assert f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}" in r.header
