import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.llm import variants
from tests.llm.plain import LOWER, awkward, documents


def plain_counts(rows, letters=6, altered=199):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if altered and h % altered == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, ratio=5):
    form = {}
    for w in counts:
        ways = sorted((-counts[x], x.encode(), x) for x in counts if near(w, x))
        form[w] = (ways[0][2] if ways and -ways[0][0] >= ratio * counts[w] else None, len(ways))
    out = {}
    for w, (f, n) in form.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out[w] = (f, root, counts[w], n, counts[f] if f else None)
    return out


def vocabulary():
    rng = random.Random(8)
    out = Counter()
    for _ in range(150):
        word = "".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(3, 9)))
        out[word] += rng.choice([5, 26, 130, 700])
        for _ in range(rng.randint(0, 6)):
            k, c = rng.randrange(len(word)), rng.choice("abcxß")
            word = rng.choice([word[:k] + c + word[k + 1 :], word[:k] + c + word[k:], word[:k] + word[k + 1 :] or "a"])
            out[word] += rng.choice([5, 5, 26, 130])
    out.update({"".join(p): 7 for p in [rng.sample("aabbccdd", 8) for _ in range(60)]})  # one point of the tree
    out.update({"x" * 700: 9, "x" * 701: 50, "x" * 350 + "y" + "x" * 349: 3, "ab": 5, "ba": 5})
    return out


@pytest.mark.parametrize("cell, members, visitors, leaf", [(2000, 8000, 60_000, 16), (12, 5, 9, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, cell, members, visitors, leaf):
    monkeypatch.setattr(variants.near_words, "__defaults__", (cell,))
    for name, value in (("MEMBERS", members), ("VISITORS", visitors), ("LEAF", leaf)):
        monkeypatch.setattr(variants, name, value)
    counts = vocabulary()
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").withColumn("near", F.lit(1))
    rows = variants.grouped_words(df).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(rows) == len(got) and got == plain_groups(counts)


def test_counts_equal_plain_version(spark):
    rows = [(i, t) for i, t, *_ in awkward()] + [(1, "again Again aGain"), (1, "again Again aGain"), (None, "nothing Nothing")]
    rows += [(i, f"Wörterbuch ÀÉÎÕÜ×÷ÿ straße naïveté {'Longer' * 40} İstanbul ﬁnally Ωmega") for i in range(300, 700)]
    df = documents(spark, [(i, t, "en", "s", 0) for i, t in rows]).withColumn("word", F.lit("x")).withColumn("n", F.lit(5))
    got = {r.word: r.n for r in variants.word_counts(df).collect()}
    assert got == plain_counts(rows)
    assert any(w not in plain_counts(rows, altered=0) for w in got)
    assert {r.word: r.n for r in variants.word_counts(df, 1, 0).collect()} == plain_counts(rows, 1, 0)


def test_empty_tables(spark):
    assert variants.spelling_variants(documents(spark, [])).count() == 0
    assert variants.spelling_variants(documents(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0)])).count() == 0
    one = [(i, "alone! words, unlike", "en", "s", 0) for i in range(5)]
    got = variants.spelling_variants(documents(spark, one)).collect()
    assert [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got] == [("unlike", None, "unlike", 5, 0, None)]


def test_search_reaches_all_in_range():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 3, (400, variants.DIMENSIONS)).astype(np.int32)
    points[:, 5:] = 0
    tree = variants.cell_tree(points, 40)
    home = {}
    variants.searched(tree, points, 0, 0, lambda leaf, rows: home.update({int(r): leaf for r in rows}))
    assert len(home) == 400 and len(set(home.values())) > 20
    for more, fewer in ((1, 1), (1, 0)):
        met = set()
        variants.searched(tree, points, more, fewer, lambda leaf, rows: met.update((int(r), leaf) for r in rows))
        for i in range(0, 400, 7):
            step = points - points[i]
            inside = (np.maximum(step, 0).sum(axis=1) <= more) & (np.maximum(-step, 0).sum(axis=1) <= fewer)
            assert all((i, home[j]) in met for j in np.flatnonzero(inside))
        assert len(met) < 400 * len(set(home.values())) / 2


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(70)] + [("a", "w069"), ("b", "a")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w070" for w, _ in chain}
