import json
import random

import pytest
from pyspark.sql import functions as F

from lockstep.functions import trees
from lockstep.operators import chains
from lockstep.operators import store as st
from tests.helpers import compact, merge_patch, random_json, rows
from tests.test_store import KIND, doc, store

MESSAGE = "struct<event:string,checksum:string,patch:string,object:string,base_object:string,patched:boolean>"


def message(event, body):
    return (event, None, body if event == "PatchObject" else None, body if event == "PutObject" else None, None, True)


def in_a_row(spark, cases):
    """Documents after three messages that are all taken, composed from the left and from the right."""
    df = spark.createDataFrame(cases, f"n int, doc string, a {MESSAGE}, b {MESSAGE}, c {MESSAGE}")
    for m in "abc":
        body = f"named_struct('leaves', {trees.leaves(f'coalesce({m}.patch, {m}.object)')})"
        df = df.withColumn(m, F.expr(f"named_struct('event', {m}.event, 'object', {m}.object, 'patched', true, 'leaves', {body}.leaves)"))
        df = df.withColumn(f"_{m}", F.expr(f"cast({chains.lift(m)} AS {chains.EDIT})"))
    df = df.withColumn("tree", F.expr(f"named_struct('version', 'v', 'doc', doc, 'tree', {trees.leaves('doc')})")).checkpoint()
    pairs = df.withColumns({"ab": F.expr(chains.then("_a", "_b")), "bc": F.expr(chains.then("_b", "_c"))}).checkpoint()
    both = pairs.withColumns({"left": F.expr(chains.then("ab", "_c")), "right": F.expr(chains.then("_a", "bc"))}).checkpoint()
    out = both.select("n", *[F.expr(chains.apply_edit(e, "tree", lambda t: "'w'")).alias(e) for e in ("left", "right")])
    return {r["n"]: (r["left"], r["right"]) for r in out.collect()}


def test_edits_compose_as_merge_patches_and_puts_do(spark):
    if spark.sparkContext.getCheckpointDir() is None:
        from lockstep.cluster import checkpoint_dir

        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    rng = random.Random(11)
    cases, want = [], {}
    for n in range(1500):
        held = random_json(rng, 3)
        cases_of, now = [], held
        for _ in range(3):
            body = random_json(rng, 3)
            if rng.random() < 0.8 and not isinstance(body, dict):
                body = {rng.choice("ab"): body}
            if rng.random() < 0.8:
                cases_of.append(message("PatchObject", compact(body)))
                now = merge_patch(now, body)
            else:
                cases_of.append(message("PutObject", compact(body)))
                now = body
        cases.append((n, compact(held), *cases_of))
        want[n] = compact(now)
    got = in_a_row(spark, cases)
    for n, (left, right) in got.items():
        assert left["doc"] == right["doc"] == want[n], cases[n]


def digest_of(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


SENT = "name string, seq bigint, event string, checksum string, patch string, object string"


def sent(spark, messages):
    return spark.createDataFrame(messages, SENT).withColumns({"kind": F.lit(KIND), "ns": F.lit("ns")}).repartition(4)


def patches(name, first, n, held):
    """Patches that fit one after another."""
    out, now = [], json.loads(held)
    for i in range(first, first + n):
        change = {"metadata": {"resourceVersion": str(i)}, "spec": {f"k{i % 7}": None if i % 5 == 0 else i, "o": {str(i % 3): i}}}
        now = merge_patch(now, change)
        out.append((name, i, "PatchObject", digest_of(compact(now)), compact(change), None))
    return out, compact(now)


def scans(monkeypatch):
    calls, real = [], chains.running
    monkeypatch.setattr(chains, "running", lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


def test_a_long_chain_that_fits_is_folded_once(spark, monkeypatch):
    calls = scans(monkeypatch)
    hot, end = patches("hot", 2, 300, doc(1, a=1))
    few, few_end = patches("few", 2, 3, doc(1, b=1))
    after, asked, _ = st.replay(store(spark, {"hot": doc(1, a=1), "few": doc(1, b=1)}), sent(spark, hot + few), per_round=8)
    assert dict(rows(after, "name", "doc")) == {"hot": end, "few": few_end}
    assert asked.count() == 0
    # one scan finds what enters each run, one that nothing was refused
    assert len(calls) == 2


def test_what_follows_a_lost_patch_is_refused_in_few_rounds(spark, monkeypatch):
    calls = scans(monkeypatch)
    held = doc(1, a=1)
    hot, _ = patches("hot", 2, 200, held)
    broken = [(n, seq, e, "off" if seq == 2 else c, p, o) for n, seq, e, c, p, o in hot]
    after, asked, _ = st.replay(store(spark, {"hot": held}), sent(spark, broken), per_round=4)
    # the first patch is lost; no later one fits, since the version of the document aside all need its member
    want, refused = st.replay(store(spark, {"hot": held}), sent(spark, broken), per_round=1000)[:2]
    assert rows(after, "name", "doc") == rows(want, "name", "doc")
    assert rows(asked, "name", "seq", "base_object") == rows(refused, "name", "seq", "base_object")
    assert asked.count() > 100 and len(calls) < 12


@pytest.mark.parametrize("check", [True, False])
def test_refused_and_unreadable_messages_in_a_chain(spark, check):
    held = doc(1, a=1)
    fits, _ = patches("k", 2, 12, held)
    lost = [m for m in fits if m[1] != 5]  # all after it miss its member until the next put
    later, _ = patches("k", 31, 9, doc(30, p=1))
    odd = [
        ("k", 20, "PutObject", None, None, "no json"),
        ("k", 21, "PatchObject", "x", "{}", None),
        ("k", 22, "PatchObject", "x", "no json", None),
        ("k", 23, "PutObject", None, None, None),
        ("k", 24, "VerifyObject", "x", None, None),
        ("k", 25, "GetObject", None, None, None),
        ("k", 26, "PutObject", None, None, '{"metadata":{"resourceVersion":"26"},"n":null}'),
        ("k", 27, "PutObject", None, None, doc(3)),
        ("k", 28, "DeleteObject", None, None, None),
        ("k", 29, "PatchObject", "x", "{}", None),
        ("k", 30, "PutObject", None, None, doc(30, p=1)),
        ("new", 1, "PatchObject", "x", "{}", None),
        ("new", 2, "PutObject", None, None, doc(5)),
        ("new", 3, "PutObject", None, None, doc(4)),
        ("new", 4, "GetObject", None, None, None),
    ]
    results = []
    for per_round in (2, 100):
        done = st.replay(store(spark, {"k": held, "idle": doc(9)}), sent(spark, lost + odd + later), check, per_round=per_round)
        results.append(
            [
                rows(done[0], "name", "version", "doc"),
                rows(done[1], "name", "seq", "base_object"),
                rows(done[2], "name", "seq", "base_object", "version", "doc"),
            ]
        )
    assert results[0] == results[1]
    assert ("idle", "9", doc(9)) in results[0][0] and len(results[0][1]) > 8
