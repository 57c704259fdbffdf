"""Plain, quadratic versions of the operators, and small awkward inputs."""

import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, words):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


def awkward():
    """Texts with copies, edits, shared passages, nulls, blanks, wide characters and a long run."""
    base, passage = prose(1, 120), prose(2, 60)
    edited = base.split()
    edited[60] = "changed"
    texts = [base, base, " ".join(edited), base.upper(), passage + " " + prose(3, 50), prose(4, 40) + " " + passage]
    texts += [None, "", "   \n\t", "one", "one two three four", "one two three four five", "é" * 150 + "日本語" * 80]
    texts += ["a" * 1500, "ab" * 700, "😀 <|endoftext|> \x1c x", prose(5, 3000), passage, passage[:199], passage[5:]]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_by_id(df, key="doc_id"):
    return {row[key]: row.asDict() for row in df.collect()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups(ids, links):
    """Smallest id reachable over the links, for each id."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def jaccard_groups(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = []
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return {i: (len(sets[i]), g) for i, g in groups(sets, links).items()}


def kept_bytes(texts, length=200):
    """id to (bytes, removed, spans, kept) of texts given as id to str or None."""
    raw = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out
