"""Words that differ by one letter, found by k-d trees over letter counts, and the forms that rare ones stand for."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import broadcast_if_small, stored, text_or_empty

LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: A run of a document is altered if this divides the CRC-32 of the two; 0 alters none.
ALTERED = 199
#: The letters are a to z and the 64 code points from here on.
FIRST_WIDE, DIMENSIONS = 0xC0, 90
#: Words of one length that a cell holds, about; a leaf of the tree inside a cell has LEAF of them.
CELL, LEAF = 2000, 16
#: Visitors of a cell that one group searches for, and members it holds, at most about.
VISITORS, MEMBERS = 60_000, 8000
#: The trees over cells are fitted on about so many words of at most LONGEST letters, and have at most MOST_CELLS leaves.
SAMPLE, LONGEST, MOST_CELLS = 100_000, 64, 1 << 16

#: A tree over cells: the number of a cell, or (dimension, threshold, tree of words up to it, tree of those beyond).
Tree = int | tuple


def word_counts(docs: DataFrame, letters: int = LETTERS, altered: int = ALTERED) -> DataFrame:
    """(word, n): how often each run of at least ``letters`` letters stands in ``docs`` (doc_id, text), A to Z in lower case.

    Runs are the longest there are of the letters A to Z, a to z and U+00C0 to U+00FF. Where ``altered`` divides the CRC-32 h of
    ``doc_id:run``, the run lacks its code point h % length, wherever it stands in that document. Null
    texts are empty, a null doc_id is the empty text, and a row that is there twice counts twice.
    Each task counts in a table of bounded size before anything is shuffled.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{max(letters, 1)},}}")
    most = 4_000_000  # letters in the table of a task

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # of UTF-8 bytes lower() changes A to Z alone
                for run, n in Counter(runs.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                    if altered:
                        h = zlib.crc32(run.encode(), start)
                        if h % altered == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                            if len(run) < letters:
                                continue
                    if run not in held:
                        size += len(run) + 16
                    held[run] += n
                if size > most:
                    yield flushed()
                    held.clear()
                    size = 0
        yield flushed()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: list[str]) -> np.ndarray:
    """The letters of words of one length as numbers, a row for each word."""
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    return np.where(raw < FIRST_WIDE, raw - ord("a"), raw - FIRST_WIDE + 26).astype(np.uint8)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """How often each letter stands in each word: the points of the trees."""
    n, length = letters.shape
    out = np.zeros((n, DIMENSIONS), np.int32)
    if length > n:
        for i, row in enumerate(letters):
            out[i] = np.bincount(row, minlength=DIMENSIONS)
    else:
        for k in range(length):
            out[np.arange(n), letters[:, k]] += 1
    return out


def _split(points: np.ndarray) -> tuple[int, int] | None:
    """The (dimension, threshold) that halves the points best; None for equal points."""
    middle = np.floor(np.median(points, axis=0)).astype(int)
    thresholds = np.stack([middle, middle - 1])
    shares = np.stack([(points <= t).mean(axis=0) for t in thresholds])
    off = np.where((shares > 0) & (shares < 1), np.abs(shares - 0.5), 2.0)
    k, dimension = np.unravel_index(int(off.argmin()), off.shape)
    return (int(dimension), int(thresholds[k, dimension])) if off[k, dimension] < 1 else None


def cell_tree(points: np.ndarray, leaves: int) -> Tree:
    """A k-d tree with up to ``leaves`` cells, by median splits of a sample of points."""
    made = 0

    def grow(at: np.ndarray, share: int) -> Tree:
        nonlocal made
        split = _split(points[at]) if share > 1 and len(at) > 1 else None
        if split is None:
            made += 1
            return made - 1
        low = points[at, split[0]] <= split[1]
        return (*split, grow(at[low], share // 2), grow(at[~low], share - share // 2))

    return grow(np.arange(len(points)), leaves)


def searched(tree: Tree, points: np.ndarray, more: int, fewer: int, found: Callable[[int, np.ndarray], None]) -> None:
    """Calls ``found(leaf, rows)`` for each leaf, with the rows of ``points`` whose range meets its box.

    The range around a point holds what has at most ``more`` letters beyond it and lacks at most ``fewer``
    of its own. A box is given by the splits above a leaf; a row whose excess over a
    box is too large is dropped there and goes no deeper.
    """
    most = np.iinfo(np.int32).max

    def visit(node: Tree, rows: np.ndarray, beyond: np.ndarray, lacking: np.ndarray, box: dict) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            found(node, rows)
            return
        dimension, threshold, left, right = node
        low, high = box.get(dimension, (0, most))
        own = points[rows, dimension]
        # a box of fewer letters: more of the own ones must go
        lost = lacking - np.maximum(own - high, 0) + np.maximum(own - threshold, 0)
        near = lost <= fewer
        visit(left, rows[near], beyond[near], lost[near], box | {dimension: (low, threshold)})
        gained = beyond - np.maximum(low - own, 0) + np.maximum(threshold + 1 - own, 0)
        near = gained <= more
        visit(right, rows[near], gained[near], lacking[near], box | {dimension: (threshold + 1, high)})

    none = np.zeros(len(points), np.int32)
    visit(tree, np.arange(len(points)), none, none, {})


def _leaf_tree(points: np.ndarray) -> tuple[Tree, list[np.ndarray]]:
    """A k-d tree whose leaves hold up to LEAF points, or equal ones, and the rows of each leaf."""
    leaves: list[np.ndarray] = []

    def grow(at: np.ndarray) -> Tree:
        split = _split(points[at]) if len(at) > LEAF else None
        if split is None:
            leaves.append(at)
            return len(leaves) - 1
        low = points[at, split[0]] <= split[1]
        return (*split, grow(at[low]), grow(at[~low]))

    return grow(np.arange(len(points))), leaves


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters ``a`` and ``b`` differ by one edit: replaced if equally long, inserted if b has one more."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    begins, ends = a == b[:, :length], a == b[:, 1:]
    no = np.zeros((len(a), 1), bool)
    ahead = np.concatenate([begins, no], axis=1).argmin(axis=1)
    behind = np.concatenate([ends[:, ::-1], no], axis=1).argmin(axis=1)
    return ahead + behind >= length


def near_in_cell(members: list[str], visitors: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(visitor, member) numbers of words one edit apart; members are of one length, visitors as long or one shorter."""
    letters = letters_of(members)
    tree, leaves = _leaf_tree(letter_counts(letters))
    lengths = np.array([len(w) for w in visitors])
    a, b = [], []
    for shorter in (0, 1):
        chosen = np.flatnonzero(lengths == letters.shape[1] - shorter)
        if not len(chosen):
            continue
        own = letters_of([visitors[i] for i in chosen])

        def compare(leaf: int, rows: np.ndarray) -> None:
            inside = leaves[leaf]
            step = max(1, 4_000_000 // (len(inside) * letters.shape[1]))  # bounded memory
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                i, j = np.repeat(part, len(inside)), np.tile(inside, len(part))
                hit = one_edit(own[i], letters[j])
                a.append(chosen[i[hit]])
                b.append(j[hit])

        searched(tree, letter_counts(own), 1, 1 - shorter, compare)
    none = np.zeros(0, int)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _trees(words: DataFrame, cell: int) -> dict[int, Tree]:
    """A tree over cells for each length that has more words than a cell, fitted on a bounded sample of them.

    Which words are found near doesn't depend on it, only how evenly they are dealt.
    """
    sizes = words.where(F.length("word") <= LONGEST).groupBy(F.length("word").alias("k")).count()
    sizes = {r["k"]: r["count"] for r in sizes.where(F.col("count") > cell).collect()}  # at most LONGEST rows
    total = sum(sizes.values())
    if not sizes:
        return {}
    share = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / total))
    sample = words.where(F.length("word").isin(list(sizes))).where(share).select("word").limit(2 * SAMPLE).toPandas()["word"]
    room = min(1.0, MOST_CELLS * cell / total)
    trees = {}
    for k, count in sizes.items():
        own = sorted(sample[sample.str.len() == k])
        if own:
            trees[k] = cell_tree(letter_counts(letters_of(own)), max(1, int(np.ceil(count / cell * room))))
    return trees


def routed(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(k, cell, home, word, n): each word in its own cell, ``home``, and in every cell where words near it may be.

    Cells of length k are visited by words of k letters, for those with one replaced, and by words of
    k - 1, for those with one inserted. Map-only.
    """
    trees = _trees(words, cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            counts = batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in found])
            for k in np.unique(lengths):
                which = np.flatnonzero(lengths == k)
                points = letter_counts(letters_of([found[i] for i in which]))
                for at, more, fewer, home in ((k, 0, 0, True), (k, 1, 1, False), (k + 1, 1, 0, False)):
                    out: list[tuple[int, np.ndarray]] = []
                    searched(trees.get(int(at), 0), points, more, fewer, lambda leaf, rows: out.append((leaf, which[rows])))
                    rows = np.concatenate([r for _, r in out])
                    cells = np.repeat([leaf for leaf, _ in out], [len(r) for _, r in out])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), at), pa.int32()),
                            pa.array(cells, pa.int32()),
                            pa.array(np.full(len(rows), home)),
                            batch.column(0).take(pa.array(rows)),
                            pa.array(counts[rows]),
                        ],
                        names=["k", "cell", "home", "word", "n"],
                    )

    return words.select("word", "n").mapInArrow(run, "k int, cell int, home boolean, word string, n bigint")


def _near(group: pd.DataFrame) -> pd.DataFrame:
    members, visitors = group[group["home"]], group[~group["home"]]
    if len(members) and len(visitors):
        i, j = near_in_cell(members["word"].tolist(), visitors["word"].tolist())
    else:
        i = j = np.zeros(0, int)
    a, b = visitors.iloc[i], members.iloc[j]
    there = pd.DataFrame({"word": a["word"].to_numpy(), "near": b["word"].to_numpy(), "near_n": b["n"].to_numpy()})
    inserted = a["word"].str.len().to_numpy() < b["word"].str.len().to_numpy()
    back = pd.DataFrame({"word": b["word"].to_numpy(), "near": a["word"].to_numpy(), "near_n": a["n"].to_numpy()})[inserted]
    return pd.concat([there, back]).astype({"near_n": "int64"})


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, near, near_n): all pairs of ``words`` (word, n) that differ by one edit, in both directions, each once.

    One edit moves a word's letter counts by two at most: one more of one letter, one
    fewer of another. Cells of words of one length are searched by those whose range meets them. A cell
    with many visitors, or with many words whose counts are all alike and so can't be split, is
    shared among several groups: all its members meet all its visitors in bounded parts.
    """
    spread = stored(routed(words, cell), "cells")
    loads = spread.groupBy("k", "cell").agg(F.count_if("home").alias("m"), F.count_if(~F.col("home")).alias("v")).where("m > 0 and v > 0")
    # one row for each cell
    loads = loads.select("k", "cell", *[F.ceil(F.col(c) / top).cast("int").alias(c) for c, top in (("m", MEMBERS), ("v", VISITORS))])
    placed = spread.join(broadcast_if_small(stored(loads, "loads")), ["k", "cell"])
    own = F.xxhash64("word")
    every_m, every_v = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("m", "v"))
    placed = placed.select(
        "k", "cell", "home", "word", "n",
        F.when(F.col("home"), F.array(F.pmod(own, F.col("m")).cast("int"))).otherwise(every_m).alias("ms"),
        F.when(F.col("home"), every_v).otherwise(F.array(F.pmod(own, F.col("v")).cast("int"))).alias("vs"),
    )
    placed = placed.withColumn("m", F.explode("ms")).withColumn("v", F.explode("vs")).drop("ms", "vs")
    return placed.groupBy("k", "cell", "m", "v").applyInPandas(_near, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where the chain from a word over its forms ends. Each round doubles the steps.

    Chains must not be circular.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = broadcast_if_small(now.select(F.col("word").alias("_at"), F.col("root").alias("_next")))
        after = now.join(ahead, F.col("root") == F.col("_at"), "left")
        after = stored(after.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def grouped_words(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), each word once.

    A word's form is the most frequent of the words one edit away, of equally frequent ones the first in
    code-point order, if it is ``ratio`` times as frequent as the word or more.
    """
    words = stored(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = stored(near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "near")
    both = words.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    both = both.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    both = stored(both, "forms")
    ends = roots(both.where("form is not null"))
    out = both.join(broadcast_if_small(ends), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of all documents with at least LETTERS letters that occur at least MIN_COUNT times, grouped by their forms."""
    return grouped_words(word_counts(docs).where(F.col("n") >= MIN_COUNT))
