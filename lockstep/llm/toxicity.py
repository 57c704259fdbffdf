"""A linear-chain conditional random field that marks toxic words, and documents by them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import text_or_empty

#: Labelled documents that the model is fitted on, at most, and bytes of the longest of them.
TRAIN_ROWS, TRAIN_BYTES = 8000, 16_384
#: Every fourth id is held out: crc32 of its text modulo FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 4, 2
#: Words in a chain. A document is as many chains as it takes.
CHAIN = 128
#: A document is toxic from this score on, a word from this marginal.
SCORE, WORD = 0.3, 0.5
#: Lengths of the beginnings of a word that are features beside the word.
PREFIXES = (4, 5, 6, 7, 8, 10, 12)
#: Features that the field may have.
MAX_FEATURES = 20_000
#: Documents are copies of one if this share of their runs of three words is common.
COPY = 0.5

_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def features(word: str) -> list[str]:
    return [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """Weights of the field and of the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Of 1, the log odds of the highest marginal, and log(1 + sum of marginals).
    document: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        """What a word says for being toxic, above the bias; 0 without a known feature."""
        known = self.weights
        return sum([known[f] for f in features(word) if f in known])


def marginals(model: Model, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log marginal odds, pair marginals, log partition) of chains: ``scores`` has one row for each, padded with anything.

    Forward and backward passes over all chains in step. Pair marginals are summed over each chain.
    """
    n, length = scores.shape
    unary = np.zeros((n, length, 2))
    unary[:, :, 1] = scores + model.bias
    forward = np.empty((n, length, 2))
    forward[:, 0] = model.start + unary[:, 0]
    for t in range(1, length):
        step = forward[:, t - 1, :, None] + model.moves
        forward[:, t] = np.logaddexp(step[:, 0], step[:, 1]) + unary[:, t]
    backward = np.zeros((n, length, 2))
    for t in range(length - 2, -1, -1):
        step = model.moves + (unary[:, t + 1] + backward[:, t + 1])[:, None, :]
        now = np.logaddexp(step[:, :, 0], step[:, :, 1])
        backward[:, t] = np.where((t + 1 < sizes)[:, None], now, 0.0)
    last = forward[np.arange(n), sizes - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])
    both = forward + backward
    pairs = np.zeros((n, 2, 2))
    for t in range(1, length):
        here = forward[:, t - 1, :, None] + model.moves + (unary[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
        pairs += np.where((t < sizes)[:, None, None], np.exp(np.minimum(here, 0)), 0.0)
    return both[:, :, 1] - both[:, :, 0], pairs, total


def _odds_to_share(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


class Scorer:
    """Scores documents by a model, remembering words and chains without a feature."""

    def __init__(self, model: Model, limit: int = 100_000):
        self.model, self.limit = model, limit
        self.known: dict[str, float] = {}
        self.plain: dict[int, tuple[float, float]] = {}

    def emissions(self, found: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in set(found).difference(known):
            known[w] = self.model.emission(w)
        return np.array([known[w] for w in found], float)

    def odds(self, documents: list[np.ndarray]) -> list[np.ndarray | None]:
        """Log marginal odds of each document's words; None for one without any feature."""
        marked = [i for i, e in enumerate(documents) if e.any()]
        rows, sizes = [], []
        for i in marked:
            e = documents[i]
            for at in range(0, len(e), CHAIN):
                part = e[at : at + CHAIN]
                rows.append(np.pad(part, (0, CHAIN - len(part))))
                sizes.append(len(part))
        out: list[np.ndarray | None] = [None] * len(documents)
        flat: list[np.ndarray] = []
        for at in range(0, len(rows), 2048):  # bounded memory
            part = np.array(sizes[at : at + 2048])
            flat += [o[:k] for o, k in zip(marginals(self.model, np.stack(rows[at : at + 2048]), part)[0], part)]
        at = 0
        for i in marked:
            chains = -(-len(documents[i]) // CHAIN)
            out[i] = np.concatenate(flat[at : at + chains])
            at += chains
        return out

    def _plain_chain(self, n: int) -> tuple[float, float]:
        if n not in self.plain:
            odds = marginals(self.model, np.zeros((1, max(n, 1))), np.array([max(n, 1)]))[0][0][:n]
            self.plain[n] = (float(odds.max(initial=-50.0)), float(_odds_to_share(odds).sum()))
        return self.plain[n]

    def summary(self, emissions: np.ndarray, odds: np.ndarray | None) -> tuple[float, float, float]:
        """What the document score goes by."""
        if odds is not None:
            top, mass = float(odds.max()), float(_odds_to_share(odds).sum())
        else:
            whole, rest = divmod(len(emissions), CHAIN)
            parts = [(*self._plain_chain(CHAIN), whole)] * bool(whole) + [(*self._plain_chain(rest), 1)] * bool(rest)
            top = max((p[0] for p in parts), default=-50.0)
            mass = sum(p[1] * p[2] for p in parts)
        return 1.0, float(np.clip(top, -20, 20)), float(np.log1p(mass))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray | None]]:
        emissions = [self.emissions(words(t)) for t in texts]
        odds = self.odds(emissions)
        x = np.array([self.summary(e, o) for e, o in zip(emissions, odds)]).reshape(-1, 3)
        return _odds_to_share(x @ self.model.document), odds


def copy_groups(documents: list[list[str]]) -> list[int]:
    """A number for each document, the same for near copies.

    Candidates share two of their smallest hashed runs of three words; each is compared
    with the first document of its bucket.
    """
    group = list(range(len(documents)))
    mixed = [(2 * zlib.crc32(b"%d" % k) + 1) & 0xFFFFFFFF for k in range(16)]

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    first: dict[tuple, int] = {}
    runs: list[np.ndarray] = []
    for i, found in enumerate(documents):
        texts = {" ".join(found[k : k + 3]) for k in range(max(len(found) - 2, 1))} if found else set()
        own = np.unique(np.fromiter((zlib.crc32(t.encode()) for t in texts), np.uint32, len(texts)))
        runs.append(own)
        if not len(own):
            continue
        least = [int((own * np.uint32(m)).min()) for m in mixed]
        for k in range(0, len(mixed), 2):
            j = first.setdefault((k, least[k], least[k + 1]), i)
            if root(j) != root(i):
                both = len(np.intersect1d(own, runs[j], assume_unique=True))
                if both >= COPY * (len(own) + len(runs[j]) - both):
                    low, high = sorted((root(i), root(j)))
                    group[high] = low
    return [root(i) for i in range(len(documents))]


def marking_features(documents: list[tuple[list[str], int]]) -> set[str]:
    """Features that stand in more toxic documents than chance explains, also if clean ones hold them.

    Copies of one document count once, so the words that only they share mark nothing. The
    bound on the likelihood ratio grows with the number of features looked at; those in too
    few documents to pass at all don't count (Tarone). What a feature weighs is left to the field.
    """
    groups = copy_groups([found for found, _ in documents])
    number: dict[str, int] = {}
    merged: tuple[dict, dict] = ({}, {})
    for (found, y), g in zip(documents, groups):
        own = np.unique(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
        merged[y].setdefault(g, []).append(own)
    if not all(merged):
        return set()
    vocabulary = list(number)
    every = [[np.unique(np.concatenate(parts)) for parts in side.values()] for side in merged]
    share = len(every[1]) / (len(every[0]) + len(every[1]))
    counted = []  # of each length of beginning: a word for each feature, and how many groups hold it
    for n in (None, *PREFIXES):
        seen: dict[str, int] = {}
        feature = np.array([seen.setdefault(w[:n], len(seen)) if len(w) >= (n or 0) else -1 for w in vocabulary])
        held = np.zeros((2, len(seen)), int)
        for y in (0, 1):
            for own in every[y]:
                here = np.unique(feature[own])
                held[y, here[here >= 0]] += 1
        one = np.zeros(len(seen), int)
        one[feature[feature >= 0]] = np.flatnonzero(feature >= 0)
        counted.append((n, one, held))
    often = np.sort(np.concatenate([held.sum(axis=0) for _, _, held in counted]))
    least = 1
    while least * -np.log(share) < (looked := np.log(len(often) - np.searchsorted(often, least) + 1)):
        least += 1
    gains: dict[str, float] = {}
    for n, one, (clean, toxic) in counted:
        p = toxic / (clean + toxic)
        gain = 2 * (toxic * np.log(np.maximum(p, 1e-9) / share) + clean * np.log(np.maximum(1 - p, 1e-9) / (1 - share)))
        for i in np.flatnonzero((p > share) & (gain >= 2 * looked)):
            word = vocabulary[one[i]]
            gains[f"={word}" if n is None else f"{n}{word[:n]}"] = gain[i]
    return set(sorted(gains, key=lambda f: (-gains[f], f[0] != "=", -len(f), f))[:MAX_FEATURES])


def fit(documents: list[tuple[str, int]], rounds: int = 40, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """A model from (text, toxic 0 or 1).

    Word labels come from the document labels: a word of a toxic document is toxic if it
    has a feature that marks toxic documents. The field is fitted to them by gradient
    steps on the likelihood, the expected counts coming from forward and backward passes.
    A logistic function of the marginals is then fitted to the documents.
    """
    one: dict[str, str] = {}  # a word is held once, however often it stands
    read = [([one.setdefault(w, w) for w in words(t)], y) for t, y in documents]
    toxic = sum(y for _, y in read)
    model = Model()
    share = min((toxic + 0.5) / (len(read) + 1), SCORE / 2)  # without a mark nothing is called toxic
    model.document = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    marks = sorted(marking_features(read))
    if not marks:
        return model
    number = {f: i for i, f in enumerate(marks)}
    known = {w: a for w in one if (a := [number[f] for f in features(w) if f in number])}
    clean = [found for found, y in read if not y]
    used = [(f, 1) for f, y in read if y]
    used += [(f, 0) for i, f in enumerate(clean) if i < max(2 * toxic, 50) or any(w in known for w in f)]
    rows, sizes, labels = [], [], []
    for found, y in used:
        active = [known.get(w, ()) for w in found]
        for at in range(0, len(found), CHAIN):
            part = active[at : at + CHAIN]
            if any(part) or at == 0:  # chains without a feature all look alike
                rows.append(part)
                sizes.append(len(part))
                labels.append([int(bool(y and a)) for a in part])
    n = len(rows)
    truth = np.zeros((n, CHAIN), int)
    place, which, beside = [], [], []
    for i, (part, y) in enumerate(zip(rows, labels)):
        truth[i, : len(y)] = y
        for t, a in enumerate(part):
            place += [i * CHAIN + t] * len(a)
            which += a
            beside += [len(a)] * len(a)
    place, which, sizes = np.array(place), np.array(which), np.array(sizes)
    inside = np.arange(CHAIN) < sizes[:, None]
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (truth[:, :-1][inside[:, 1:]], truth[:, 1:][inside[:, 1:]]), 1)
    counts = np.bincount(which, weights=beside, minlength=len(marks)) + 1.0
    weights = np.zeros(len(marks))
    for _ in range(rounds):
        scores = np.zeros(n * CHAIN)
        np.add.at(scores, place, weights[which])
        odds, pairs, _ = marginals(model, scores.reshape(n, CHAIN), sizes)
        p = np.where(inside, _odds_to_share(odds), 0.0)
        miss = (truth - p).ravel()
        # each step is scaled by how often a feature, with those beside it, or a pair of states is seen
        weights += rate * 4 * (np.bincount(which, weights=miss[place], minlength=len(marks)) / counts - decay * weights)
        model.bias += rate * miss.sum() / max(truth.sum(), 1)
        first = np.array([1 - p[:, 0], p[:, 0]]).sum(axis=1)
        model.start += rate * (np.bincount(truth[:, 0], minlength=2) - first) / n
        model.moves += rate * (seen_pairs - pairs.sum(axis=0)) / np.maximum(seen_pairs.sum(axis=1, keepdims=True), 1)
        model.bias = float(np.clip(model.bias, -20, 20))
    model.weights = {f: float(weights[i]) for f, i in number.items()}
    model.document = _logistic(model, documents)
    return model


def _logistic(model: Model, documents: list[tuple[str, int]], rounds: int = 50) -> np.ndarray:
    scorer = Scorer(model)
    emissions = [scorer.emissions(words(t)) for t, _ in documents]
    x = np.array([scorer.summary(e, o) for e, o in zip(emissions, scorer.odds(emissions))])
    y = np.array([y for _, y in documents], float)
    beta = np.zeros(3)
    for _ in range(rounds):  # Newton's steps on the penalised likelihood
        p = _odds_to_share(x @ beta)
        slope = x.T @ (y - p) - 0.1 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, longest: int = TRAIN_BYTES) -> Model:
    """A model from at most ``rows`` labelled documents of at most ``longest`` bytes, held-out ids left out.

    That bounded sample, taken in the order of a hash of the id, is all that reaches the
    driver. Rows without a label or text are no examples; of repeated labels the
    larger counts, of repeated documents the smallest text.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))  # bounded by rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.col("text").isNotNull() & (F.octet_length("text") <= longest)
    )
    found = texts.join(sample, "doc_id").select("doc_id", "text", "toxic").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas()
    found = found.sort_values("doc_id")
    return fit(list(zip(found["text"], found["toxic"].astype(int))))


def _score(model: Model, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts = batch.column(len(batch.schema) - 1).to_pylist()
                scores, odds = scorer.scores(texts)
                columns = [batch.column(i) for i in range(len(batch.schema) - 1)] + [pa.array(scores)]
                names = [*batch.schema.names[:-1], "score"]
                if with_spans:
                    columns.append(pa.array([spans(t, o) for t, o in zip(texts, odds)], pa.list_(_SPAN)))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])


def spans(text: str, odds: np.ndarray | None) -> list[dict]:
    """Where the toxic words are, in code points of the text; those next to each other joined."""
    out: list[dict] = []
    if odds is None or odds.max() < np.log(WORD / (1 - WORD)):
        return out
    low, joined = text.lower(), False
    for match, share in zip(_WORDS.finditer(low), _odds_to_share(odds).tolist()):
        if share >= WORD and joined:
            out[-1] = {"start": out[-1]["start"], "end": match.end(), "marginal": max(share, out[-1]["marginal"])}
        elif share >= WORD:
            out.append({"start": match.start(), "end": match.end(), "marginal": share})
        joined = share >= WORD
    if len(low) != len(text):  # some letters become two in lower case
        place = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
        for span in out:
            span["start"], span["end"] = int(place[span["start"]]), int(place[span["end"] - 1]) + 1
    return out


def scored(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """``docs`` with ``score`` and, if wanted, ``spans`` (start, end, marginal) of toxic words.

    Map-only, by the text alone; null texts are empty. Columns of these names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("score", "spans", "_scored")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["score double"])
    if with_spans:
        schema += ", spans array<struct<start: int, end: int, marginal: double>>"
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty().alias("_scored"))
    return rows.mapInArrow(_score(model, with_spans), schema)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: whether its id is held out, its score, and 1 for toxic or 0."""
    model = train(docs, labels)
    out = scored(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= SCORE).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score as toxic; columns as they are."""
    own = {c: f"_keep_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    kept = scored(rows, train(docs, labels)).where(F.col("score") < SCORE)
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
