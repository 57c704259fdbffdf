import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.llm import ngrams, repeats, shingling, suffixes, syncmers, toxicity
from tests.llm.plain import awkward, documents, jaccard_groups, kept_bytes, prose, rows_by_id, shingles


def near_copies(n, words, seed):
    """A text and copies with more and more changed words, some joined only through others."""
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = [" ".join(base)]
    for k in range(n):
        copy = list(base)
        for _ in range(k % 8):
            copy[rng.randrange(words)] = prose(seed * 1000 + k, 1)
        out.append(" ".join(copy))
    return out


def test_jaccard_groups_equal_brute_force(spark):
    rows = awkward()
    texts = [r[1] for r in rows] + near_copies(40, 80, 11) + near_copies(25, 30, 12)
    passage = prose(99, 30)
    texts += [prose(200 + k, 10 + k) + " " + passage for k in range(20)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = rows_by_id(ngrams.jaccard_groups(documents(spark, rows)))
    want = jaccard_groups({i: t for i, t, *_ in rows})
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert len(set(g for _, g in want.values())) < len(want) - 15


def test_jaccard_threshold_is_exact(spark):
    words = prose(5, 64).split()  # 60 shingles; a cut at the end leaves n of them
    rows = [(k, " ".join(words[: 64 - k]), "en", "s", 0) for k in range(0, 20)]
    got = rows_by_id(ngrams.jaccard_groups(documents(spark, [r for r in rows if r[0] in (0, 12)])))
    assert got[12]["component_id"] == 0  # 48 of 60
    got = rows_by_id(ngrams.jaccard_groups(documents(spark, [r for r in rows if r[0] in (0, 13)])))
    assert got[13]["component_id"] == 13  # 47 of 60


def test_jaccard_with_repeated_and_null_ids(spark):
    text = prose(1, 50)
    rows = [(5, text, "en", "s", 0), (5, text, "en", "s", 0), (3, text, "en", "s", 0), (5, prose(2, 50), "en", "s", 0), (None, text, "en", "s", 0)]
    got = sorted(ngrams.jaccard_groups(documents(spark, rows)).select("component_id").toPandas()["component_id"])
    assert got == [3, 3, 3, 3, 5]
    kept = ngrams.one_of_each_group(documents(spark, rows).withColumn("token", F.lit(1)))
    assert kept.columns[-1] == "token"
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, text), (5, prose(2, 50))])


def test_different_texts_of_one_id_stay(spark):
    a, b = prose(11, 40), prose(12, 40)
    rows = [(5, a, "en", "s", 0), (5, b, "en", "s", 0), (9, b, "en", "s", 0), (None, a, "en", "s", 0), (None, prose(13, 40), "en", "s", 0)]
    rows += [(7, None, "en", "s", 0), (7, None, "en", "s", 0), (8, " ", "en", "s", 0), (None, "", "en", "s", 0)]
    kept = ngrams.one_of_each_group(documents(spark, rows)).collect()
    want = [(5, a), (5, b), (None, prose(13, 40)), (7, None), (8, " "), (None, "")]
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept])) == sorted(map(str, want))


def test_shingle_sets_over_long_words_and_blocks():
    texts = ["x" * 6000 + " a b c d", "A B c d e  f", "", " ", "w " * 3, "x" * (shingling.LONG + 1), ("v" * 50 + "\n") * 20_000]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    sets = [s for a, b in shingling.blocks(bounds) for s in shingling.shingle_sets(data, bounds[a : b + 1], 5)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    alone = np.frombuffer(b"a b C D e f", np.uint8)
    assert (next(shingling.shingle_sets(alone, np.array([0, 11]), 5)) == sets[1]).all()


def test_suffix_arrays_equal_sorting():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(30)] + [b"aaaaaaaaaaaaaaaaaaaaaa"] * 2 + [b"\0\0\0\0"]
    shard = suffixes.Shard(strings, 8)
    order = shard.suffix_array()
    text, ends = shard.text.tobytes(), shard.ends
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (text[i : ends[i]], i))
    common = shard.common_prefixes()

    def prefix(i, j):
        a, b = text[i : ends[i]], text[j : ends[j]]
        return min(next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))), 8)

    assert [common[j] for j in order[1:]] == [prefix(i, j) for i, j in zip(order, order[1:])]
    windows = [text[i : i + 8] if i + 8 <= ends[i] else None for i in range(len(text))]
    assert shard.repeated().tolist() == [w is not None and windows.count(w) > 1 for w in windows]
    other = suffixes.Shard([bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(10)], 8)
    asked = np.array([i for i in range(len(other.text)) if i + 8 <= other.ends[i]])
    found, hit = shard.find(other, asked)
    wanted = [other.text[i : i + 8].tobytes() for i in asked]
    assert found.tolist() == [w in windows for w in wanted]
    assert hit.tolist() == [w is not None and w in wanted for w in windows]


def test_runs_hold_every_window_once():
    rng = np.random.default_rng(2)
    raw = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (0, 5, 200, 199, 1000, 3)] + [b"z" * 700, b"q" * (repeats.BLOCK + 900)]
    bounds = np.cumsum([0, *map(len, raw)])
    seen = []
    for _, anchor, first, count, text in repeats.window_runs(np.frombuffer(b"".join(raw), np.uint8), bounds, 200, 40):
        for f, c, t, a in zip(first, count, text, anchor):
            assert bounds[t] <= f and f + c + 199 <= bounds[t + 1] and f + c - 1 <= a <= f + 160
            seen += range(f, f + c)
    assert sorted(seen) == [i for k, b in enumerate(raw) for i in range(bounds[k], bounds[k] + max(0, len(b) - 199))]


@pytest.mark.parametrize("per_shard", [4000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, per_shard):
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (repeats.LENGTH, repeats.GRAM, per_shard))
    passage = prose(50, 45)
    texts = [r[1] for r in awkward()] + [prose(60 + k, 20 + 3 * k) + " " + passage[k : 250 + k] + prose(90 + k, 30) for k in range(12)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[4], "en", "s", 0), (3, prose(61, 22), None, None, 0)]
    got = repeats.repeats_in_documents(documents(spark, rows)).collect()
    want = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in kept_bytes([r[:2] for r in rows])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_text_without_repeats_stays_text(spark):
    shared = "ä" * 150
    rows = [(1, "é" + shared + "ü" + prose(1, 30), "de", "s", 0), (2, "è" + shared + "ö" + prose(2, 30), "de", "s", 7)]
    df = documents(spark, rows).withColumnRenamed("source", "spans")
    out = rows_by_id(repeats.without_repeats(df))
    assert list(out[1]) == df.columns and out[2]["spans"] == "s"
    assert out[1]["text"].endswith(prose(1, 30)) and "ä" not in out[1]["text"]
    assert out[1]["n_chars"] == len(out[1]["text"])


def test_fingerprints(spark):
    rows = awkward()
    got = rows_by_id(syncmers.fingerprinted_documents(documents(spark, rows).withColumn("found", F.lit(1))))
    order = sorted(rows, reverse=True)
    by_text = {}
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    long = next(i for i, t, *_ in rows if t and len(t) > 10_000)
    assert got[long]["near_edited"] > 0.4 > got[long]["near_next"]
    assert got[0]["near_next"] < 0.2 and got[1]["near_next"] == 1.0  # 1 and 0 are copies


def test_next_row_over_ranges(spark):
    rng = random.Random(4)
    ids = [rng.randrange(-(10**15), 10**15) for _ in range(300)] + [5, 5, None]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "id bigint, v string").withColumn("u", F.monotonically_increasing_id())
    got = syncmers.with_next(df, "id", ["v"], F.col("u"), ranges=7).collect()
    order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
    after = [str(order[(k + 1) % len(order)]) for k in range(len(order))]
    assert sorted(map(str, [(r.id, r.next_v) for r in got])) == sorted(map(str, zip(order, after)))
    alone = spark.createDataFrame([(7, "x")], "id bigint, v string")
    one = syncmers.with_next(alone, "id", ["v"], F.col("v")).collect()
    assert one[0].v == one[0].next_v


def test_syncmers_are_free_of_context(spark):
    middle = prose(7, 200)
    df = spark.createDataFrame([(prose(8, 100) + " " + middle,), (middle + " " + prose(9, 150),)], "text string")
    a, b = (r.a for r in df.select(syncmers.anchors(F.col("text")).alias("a")).collect())
    assert len(set(a) & set(b)) > 30
    pairs = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(syncmers.matches(F.col("a"), F.col("b")).alias("m")).first().m
    assert len({p.left - p.right for p in pairs}) == 1  # all at one shift


def test_toxicity_learns_marks_and_offsets(spark):
    bad = ["grobian", "flegel"]
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        words, toxic = prose(i, rng.randint(20, 300)).split(), int(i % 8 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "en", "s"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, toxic))
    rows += [(1000, None, "en", "s", 0), (1001, "", None, None, None), (None, "flegel und flegelen", "en", "s", 0)]
    labels += [(1000, 1, 1), (5, 0, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = documents(spark, rows)
    got = toxicity.scored_documents(docs, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [i for i in range(400) if by[i].held_out]
    assert 60 < len(held) < 140
    assert all(by[i].predicted == int(i % 8 == 0) for i in held)
    assert by[1000].predicted == by[1001].predicted == 0 and by[None].predicted == 1
    clean = toxicity.clean_documents(docs.withColumnRenamed("source", "score"), table)
    assert clean.columns == [c if c != "source" else "score" for c in docs.columns]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.predicted}
    model = toxicity.train(docs, table)
    row = spark.createDataFrame([("So ein FLEGEL, sagte er.",)], "text string")
    spans = toxicity.scored(row, model, with_spans=True).first().spans
    assert [(s.start, s.end) for s in spans] == [(7, 13)]
    row = spark.createDataFrame([("İİ So ein FLEGEL İ.",)], "text string")
    spans = toxicity.scored(row, model, with_spans=True).first().spans
    assert [(s.start, s.end) for s in spans] == [(10, 16)]


def test_likeness_across_the_short_length(spark):
    long, ten = prose(70, 200)[:600], "0123456789"
    near = prose(71, 200)
    rows = [(9, long, "en", "s", 0), (8, ten, "en", "s", 0), (7, near[:515], "en", "s", 0), (6, near[:510], "en", "s", 0), (5, "  \n", "en", "s", 0), (4, "", "en", "s", 0)]
    got = rows_by_id(syncmers.fingerprinted_documents(documents(spark, rows)))
    assert got[9]["near_edited"] > 0.4  # 400 of the 600 characters stay
    assert got[7]["near_next"] > 0.8 and got[9]["near_next"] == 0
    assert got[8]["near_edited"] < 1 and got[5]["near_next"] == 0
    sets = {i: {f[k : k + 8] for k in range(0, len(f), 8)} for i, f in ((i, r["fingerprint"]) for i, r in got.items())}
    assert all(len(a) == 8 for s in sets.values() for a in s) and len(sets[7] & sets[6]) > 0.8 * len(sets[7])


def test_every_feature_with_evidence_marks():
    rng = random.Random(8)
    documents = []
    for i in range(400):
        found, toxic = prose(3000 + i, 40).split(), int(i % 8 == 0)
        if toxic and i % 16 == 0:
            found[3], found[20] = "grobian", "flegel"  # never one without the other
        elif toxic:
            found[5], found[30] = (f"schurkisch{rng.choice('bcdfgklm')}{rng.choice('aeiou')}" for _ in range(2))
        elif i % 25 == 1:
            found[9] = "schurkische"  # clean documents hold the stem too
        documents.append((found, toxic))
    copied = prose(9999, 40).split()
    documents += [([*copied[:k], "zzz", *copied[k:]], 1) for k in range(0, 40, 4)]
    marks = toxicity.marking_features(documents)
    assert {"=grobian", "=flegel", "7schurki", "10schurkisch"} <= marks
    assert not marks & {f"={w}" for w in copied if len(w) > 4}
    model = toxicity.fit([(" ".join(found), y) for found, y in documents])
    assert all(model.emission(w) > 0 for w in ("grobian", "flegel", "schurkischba"))
    scores, _ = toxicity.Scorer(model).scores([prose(5000, 40) + " flegel", prose(5001, 40) + " schurkischga schurkischmu", prose(5002, 40)])
    assert scores[0] >= toxicity.SCORE and scores[1] >= toxicity.SCORE > scores[2]


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    model = toxicity.Model(bias=0.3, start=rng.normal(size=2), moves=rng.normal(size=(2, 2)))
    scores, n = rng.normal(size=(1, 6)), 4
    odds, pairs, total = toxicity.marginals(model, scores, np.array([n]))
    weight = {}
    for path in itertools.product((0, 1), repeat=n):
        w = model.start[path[0]] + sum(s * (x + model.bias) for s, x in zip(path, scores[0]))
        weight[path] = np.exp(w + sum(model.moves[a, b] for a, b in zip(path, path[1:])))
    z = sum(weight.values())
    assert np.isclose(total[0], np.log(z))
    for t in range(n):
        p = sum(w for path, w in weight.items() if path[t]) / z
        assert np.isclose(odds[0, t], np.log(p / (1 - p)))
    moves = np.zeros((2, 2))
    for path, w in weight.items():
        for a, b in zip(path, path[1:]):
            moves[a, b] += w / z
    assert np.allclose(pairs[0], moves)


def test_empty_tables(spark):
    none = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert ngrams.jaccard_groups(none).count() == 0
    assert repeats.repeats_in_documents(none).count() == 0
    assert syncmers.fingerprinted_documents(none).count() == 0
    assert toxicity.scored_documents(none, labels).count() == 0
    assert toxicity.clean_documents(documents(spark, awkward()), labels).count() == len(awkward())


def test_next_over_ids_far_apart(spark):
    rows = [(-(1 << 63), "low text here", "en", "s", 0), (5, "middle text", "en", "s", 0), ((1 << 63) - 1, "high words there", "en", "s", 0)]
    got = rows_by_id(syncmers.fingerprinted_documents(documents(spark, rows)))
    assert set(got) == {r[0] for r in rows}
