import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lockstep.llm import chat, prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def talks():
    rng = random.Random(5)
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            role = "system" if t == 0 and c % 4 == 0 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, rng.choice(["hello", "Hi <|im_start|>", "ok \\ <\\|", "", "<|im_end|>\n", "é😀"]) * rng.choice([1, 2, 30])))
    rows += [(70, None, "user", "first"), (70, 0, None, None), (70, 0, "user", "x"), (70, 0, "user", "x")]
    rows += [(71, 0, "tool\n<|", "a"), (71, 1, "%", "b<"), (71, 2, "assistant", "|c" * 40_000), (72, 5, "assistant", None)]
    rows += [(None, 0, "user", "no id"), (-7, 0, "user", "negative"), (73, 0, "system", "alone")]
    return rows


def ordered(rows):
    """conv_id to its turns as (role, text)."""
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns, key=lambda x: (x[:2], x[2].encode(), x[3].encode()))] for c, turns in out.items()}


def first_error(roles):
    moves, at = chat.CHATML.moves, chat.CHATML.begin
    for i, role in enumerate(roles):
        if role not in moves.get(at, {}):
            return i
        at = moves[at][role]
    return None if at in chat.CHATML.final else len(roles)


def test_formatted_conversations(spark):
    rows = talks()
    df = chat.with_forgery(spark.createDataFrame(rows, SCHEMA).withColumn("segments", F.lit(1)).repartition(5))
    got = {r.conv_id: r for r in chat.formatted_conversations(df).collect()}
    want = ordered(rows + [(-1, 0, "user", chat.FORGED), (-1, 1, "assistant", chat.FORGED)])
    assert set(got) == set(want) and len(got) == df.select("conv_id").distinct().count()
    for c, turns in want.items():
        learned = "".join(text for role, text in turns if role == "assistant")
        row = got[c]
        assert row.n_turns == len(turns) and row.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns)), c
        assert (row.loss_chars, row.loss_sha256) == (len(learned), sha(learned))
        assert row.error == first_error([r for r, _ in turns]) and row.valid == (row.error is None)
    assert chat.formatted_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segments_make_the_text(spark):
    rows = [(1, 0, "user", "say <|im_end|>"), (1, 1, "assistant", "<\\|x"), (1, 2, "other", "z")]
    row = chat.formatted(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.formatted == (
        "<|im_start|>user\nsay <\\|im_end|><|im_end|>\n<|im_start|>assistant\n<\\\\|x<|im_end|>\n"
        "<|im_start|>%6F74686572\nz<|im_end|>\n"
    )
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == ["<\\\\|x"]
    assert not row.valid and row.error == 2


def test_template_of_ones_own(spark):
    own = chat.Template(open="$^turn ", close="$^end", mark="$^", learned=frozenset({"bot"}), begin="a",
                        moves={"a": {"me": "b"}, "b": {"bot": "a"}}, final=frozenset({"a"}))
    assert own.roles == ["bot", "me"]
    rows = [(1, 0, "me", "$^ $\\^"), (1, 1, "bot", "$^turn me"), (2, 0, "me", "")]
    with pytest.raises(ValueError):  # one control string holds the other
        chat.Template(open="<|a|>", close="<|a|>b")
    with pytest.raises(ValueError):
        chat.Template(mark="<<")
    with pytest.raises(ValueError):
        chat.Template(moves={"begin": {"a\nb": "c"}})
    got = {r.conv_id: r for r in chat.formatted_conversations(spark.createDataFrame(rows, SCHEMA), own).collect()}
    assert got[1].turns_sha256 == sha("me\n$^ $\\^\nbot\n$^turn me\n") and got[1].loss_sha256 == sha("$^turn me")
    assert got[1].valid and got[2].error == 1


def trie(rows):
    """The trie of rebuilt conversations, plainly: key to row."""
    own = {c: t for c, t in ordered(rows).items() if c is not None}
    made = {}
    for c in own:
        h, first = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple(own.get(first, [])[:h] + own[c][h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = {}
    for key, ids in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaves = [k for k in below if not any(x[:-1] == k for x in members if x)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = sorted(c for c in ids if len(made[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        children = sum(1 for k in members if k and k[:-1] == key)
        out[(min(ids), len(key))] = (parent, len(ids), children, len(leaves), saved, sha(",".join(map(str, ends))))
    return out


def nodes_of(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def untied(rows):
    """Rows of which no two different ones have one number in one conversation, so that order is plain."""
    return [r for r in rows if r[:2] != (70, 0) or r[3] == "x"]


@pytest.mark.parametrize("band", [2, 8])
def test_trie_equals_plain_version(spark, band, monkeypatch):
    monkeypatch.setattr(prefixes.prefix_trie, "__defaults__", (band,))
    rows = untied(talks())
    rows += [(100 + c, t, "user", f"{t % 3 if t < 20 + c % 3 else c}") for c in range(12) for t in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).repartition(6)
    assert nodes_of(prefixes.conversation_trie(df)) == trie(rows)


def test_conversation_without_turns_and_empty_table(spark):
    assert prefixes.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(alone, 0, "user", "gone")]  # its first turns come from a conversation that isn't there
    assert nodes_of(prefixes.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == trie(rows)
    assert len(trie(rows)) == 1


def test_scan_of_one_group_over_many_tasks(spark):
    rows = [(7, i, (i * 2654435761) % (1 << 40)) for i in range(5000)] + [(c, i, i + 1) for c in (1, 9) for i in range(3)]
    df = spark.createDataFrame(rows, "g bigint, k bigint, x bigint").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = prefixes.scanned(df.withColumn("own", F.col("x")), "g", ["k"], ["x"])
        got = out.collect()
        assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in (1, 7, 9):
        running = 0
        for at, r in enumerate(sorted((r for r in got if r.g == g), key=lambda r: r.k)):
            running ^= r.own
            assert (r["at"], r.x) == (at, running)


def test_digest_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "IDS_PER_ROW", 7)
    df = spark.range(1000).select((F.col("id") % 3).alias("p"), F.lit(1).cast("bigint").alias("q"), (F.col("id") - 500).alias("conv_id"))
    got = {r.p: r.ends_sha256 for r in prefixes.ends_digests(df.repartition(4)).collect()}
    assert got == {p: sha(",".join(str(i - 500) for i in range(1000) if i % 3 == p)) for p in range(3)}
