"""Jaccard join of documents on word n-grams, with prefix filters under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockstep.llm.common import broadcast_if_small, components, stored, text_bytes, text_or_empty
from lockstep.llm.shingling import blocks, reordered, shingle_sets

WORDS = 5
#: Documents link when PART * intersection >= SHARE * union.
SHARE, PART = 80, 100
#: Prefixes are longer than they need to be by a SPARE-th of the set, so that pairs share more tokens than one.
SPARE = 20
#: Salts of the further orders that a candidate pair must pass.
FURTHER_ORDERS = (1, 2)
#: Tokens of the sets that are compared in one group of a task, about.
TOGETHER = 1_000_000


def least_shared(size: int) -> int:
    """The fewest tokens that a set of ``size`` shares with any set it links with."""
    return -(-size * SHARE // PART)


def prefix_length(size: int) -> int:
    """Tokens of the prefix under the first order.

    Two linked sets share at least ``1 + min(sizes) // SPARE`` tokens of their prefixes: the
    smallest shared tokens stand behind no more than ``size - least_shared(size)`` others.
    """
    return size - least_shared(size) + 1 + size // SPARE


def prefix_shared(size: Column) -> Column:
    """Prefix tokens that a set of ``size`` shares with whichever it links with: those are at least SHARE / PART as large."""
    return 1 + F.floor(size * SHARE / (PART * SPARE))


def _set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, set_id, prefix)."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        for a, b in blocks(bounds):
            sizes, ids, prefixes = [], [], []
            for tokens in shingle_sets(data, bounds[a : b + 1], WORDS):
                sizes.append(len(tokens))
                ids.append(_set_id(tokens) if len(tokens) else None)
                prefixes.append(tokens[: prefix_length(len(tokens))] if len(tokens) else tokens)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            values = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                ],
                names=["doc_id", "n", "set_id", "prefix"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id, text) to (set_id, n, tokens)."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        for a, b in blocks(bounds):
            sets = list(shingle_sets(data, bounds[a : b + 1], WORDS))
            sizes = [len(s) for s in sets]
            ends = np.cumsum([0, *sizes]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), tokens],
                names=["set_id", "n", "tokens"],
            )


def _meant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (set_id, text) the rows whose text has that set, where ids of documents repeat."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        found = [_set_id(s) for a, b in blocks(bounds) for s in shingle_sets(data, bounds[a : b + 1], WORDS)]
        yield batch.filter(pa.array(np.array(found, np.int64) == batch.column(0).to_numpy()))


def promising(classes: DataFrame) -> DataFrame:
    """(set_id): the sets that may link, by their prefixes under the first order, the hash itself.

    A set shares ``prefix_shared`` tokens of its prefix or more with whichever it links
    with, so one with fewer that any other set holds in its own prefix is gone.
    """
    rows = classes.select("set_id", "n", F.explode("prefix").alias("token"))
    held = rows.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("held > 1")
    shared = held.groupBy("set_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return shared.where(F.col("shared") >= prefix_shared(F.col("n"))).select("set_id")


def index(texts: DataFrame) -> DataFrame:
    """(token, set_id, n, rank, own): under which tokens a set must look for others, of the texts that are left.

    Second order: by how many of these sets hold a token, rarest first, so that passages
    that many documents share come last. Tokens of one set alone need no entry, but they
    take their place in its prefix: a set of which more than ``size - least_shared(size)``
    are its own links with none. ``rank`` is the token's place in the set, from 1, and
    ``own`` the part of the set that no other holds.
    """
    rows = texts.mapInArrow(_sets, "set_id bigint, n bigint, tokens array<bigint>")
    rows = rows.select("set_id", "n", F.explode("tokens").alias("token"))
    by_set = Window.partitionBy("set_id")
    held = rows.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("held > 1")
    ranked = held.withColumn("shared", F.count(F.lit(1)).over(by_set))
    ranked = ranked.withColumn(
        "rank", F.row_number().over(by_set.orderBy("held", "token")) + F.col("n") - F.col("shared")
    )
    last = F.col("n") - F.ceil(F.col("n") * SHARE / PART) + 1
    return stored(
        ranked.where(F.col("rank") <= last).select(
            "token", "set_id", "n", "rank", ((F.col("n") - F.col("shared")) / F.col("n")).cast("float").alias("own")
        ),
        "token-index",
    )


def _may_link(a: str, b: str) -> Column:
    """Whether sets that meet at a token can link if it is the first that they share: sizes and what is left behind it."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.rank"), F.col(f"{b}.n") - F.col(f"{b}.rank")) + 1
    return left * (PART + SHARE) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * SHARE


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """The pairs (a, b) of a group that link; rows of ``a`` equal to ``b`` are there for the text of b.

    Candidates must meet in the prefixes under all further orders before the sets are compared.
    """
    raw = [t.encode() for t in group["text"]]
    bounds = np.cumsum([0, *map(len, raw)])
    sets = list(shingle_sets(np.frombuffer(b"".join(raw), np.uint8), bounds, WORDS))
    fronts = [
        [np.sort(reordered(s, k)[: len(s) - least_shared(len(s)) + 1]) for k in FURTHER_ORDERS] for s in sets
    ]
    pairs = list(zip(group["a"].tolist(), group["b"].tolist()))
    at = {b: i for i, (a, b) in enumerate(pairs) if a == b}
    out = []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            continue
        j = at[b]
        if all(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(fronts[i], fronts[j])):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * PART >= (len(sets[i]) + len(sets[j]) - both) * SHARE:
                out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, n), ``n`` the size of a's set, that link.

    Pairs of one ``b`` are compared in one place, or, where they are many, in several that
    each get b's text. Texts move rather than sets: they are smaller.
    """
    pairs = stored(pairs, "pairs")
    loads = pairs.groupBy("b").agg(F.ceil(F.sum("n") / TOGETHER).cast("int").alias("parts"))
    places = F.lit(max(1, int((pairs.agg(F.sum("n")).first()[0] or 0) // TOGETHER)))
    loads = stored(loads.withColumn("place", F.pmod(F.xxhash64("b"), places)), "loads")
    texts = texts.select(F.col("set_id").alias("id"), "text")
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")
    members = pairs.join(broadcast_if_small(loads), "b").select("place", part, "a", "b")
    members = texts.join(broadcast_if_small(stored(members, "members")), F.col("id") == F.col("a"))
    leaders = texts.join(broadcast_if_small(loads), F.col("id") == F.col("b"))
    leaders = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = members.select("place", "part", "a", "b", "text").unionByName(
        leaders.select("place", "part", F.col("b").alias("a"), "b", "text")
    )
    return stored(both.groupBy("place", "part").applyInPandas(_compare, "a bigint, b bigint"), "links")


def set_links(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that join whatever all links join.

    1. Of each token's sets one is the leader: that of which least is its own, as in the
       original of many edited copies. Every set is compared with its leaders.
    2. What is joined so far needs no further comparison. Under each token the sets outside
       the largest joined group are compared with all sets of other groups.
    """
    columns = ["set_id", "n", "rank"]
    first = entries.groupBy("token").agg(
        F.min(F.struct("own", F.xxhash64("set_id").alias("h"), *columns)).alias("first"), F.count(F.lit(1)).alias("m")
    )
    first = first.where("m > 1").select("token", *[f"first.{c}" for c in columns])
    a, b = entries.alias("a"), first.alias("b")
    led = a.join(b, F.col("a.token") == F.col("b.token")).where(
        (F.col("a.set_id") != F.col("b.set_id")) & _may_link("a", "b")
    )

    def pairs(joined: DataFrame) -> DataFrame:
        return joined.select(
            F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"), F.col("a.n").alias("n")
        ).distinct()

    links = _verified(pairs(led), texts)
    groups = components(links)
    grouped = entries.drop("own").join(groups, F.col("set_id") == F.col("node"), "left")
    grouped = grouped.select("token", *columns, F.coalesce("component", "set_id").alias("g"))
    grouped = stored(grouped, "grouped-tokens")
    sizes = grouped.groupBy("token", "g").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("m", "g")).alias("top"))
    mixed = mixed.where("groups > 1").select("token", F.col("top.g").alias("top"))
    mixed = stored(grouped.join(mixed, "token"), "mixed-tokens")
    a, b = mixed.where("g != top").alias("a"), mixed.alias("b")
    cross = a.join(b, F.col("a.token") == F.col("b.token")).where(
        (F.col("a.g") != F.col("b.g"))
        & ((F.col("b.g") == F.col("b.top")) | (F.col("a.set_id") < F.col("b.set_id")))
        & _may_link("a", "b")
    )
    return links.union(_verified(pairs(cross), texts))


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set_id, g) of every row of ``docs`` (doc_id, text): its set, and a set of its group, null without words."""
    sets = docs.mapInArrow(_prefixes, "doc_id bigint, n bigint, set_id bigint, prefix array<bigint>")
    sets = stored(sets, "prefixes")
    classes = sets.where("set_id is not null").groupBy("set_id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    chosen = sets.select("set_id", F.col("doc_id").alias("one")).join(stored(promising(classes), "promising"), "set_id")
    chosen = stored(chosen.groupBy("set_id").agg(F.min("one").alias("one")), "chosen")
    texts = docs.join(broadcast_if_small(chosen), F.col("doc_id").eqNullSafe(F.col("one"))).select("set_id", "text")
    texts = stored(texts.mapInArrow(_meant, "set_id bigint, text string"), "texts")
    if texts.count() > texts.select("set_id").distinct().count():  # repeated rows
        texts = stored(texts.dropDuplicates(["set_id"]), "texts")
    groups = components(set_links(index(texts), texts))
    rows = sets.select("doc_id", "n", "set_id").join(groups, F.col("set_id") == F.col("node"), "left")
    return rows.select("doc_id", "n", "set_id", F.coalesce("component", "set_id").alias("g"))


def _plain_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Equal sets are one class before anything is indexed, so exact copies cost one row.
    Rows without words link with nothing and are their own component; a null doc_id counts
    as larger than any other and names a component only of such rows. Tokens and classes
    are 64-bit hashes. Texts are read twice: for the prefixes of all documents, and for
    one document of each class that the first order leaves.
    """
    rows = _grouped(_plain_columns(docs))
    names = rows.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "g", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _with_set_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, their last column, a text, replaced by the id of its set."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(batch.num_columns - 1))
        sets = (s for a, b in blocks(bounds) for s in shingle_sets(data, bounds[a : b + 1], WORDS))
        ids = pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "_set"])


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of documents that link, over however many links; columns stay as they are.

    The row of the smallest doc_id stays, null being the largest; of different texts
    with one doc_id, that of the smallest set. Rows without words are in no group and stay. Rows that
    share a doc_id and a text stay once, and rows that share a doc_id alone are different documents.
    """
    rows = stored(_grouped(_plain_columns(docs)), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id")
    first = rows.where("g is not null").groupBy("g").agg(F.min(order).alias("first")).select("first.doc_id", "first.set_id")
    kept = first.unionByName(rows.where("g is null").select("doc_id", "set_id")).distinct()
    kept = stored(kept.select(F.col("doc_id").alias("_doc"), F.col("set_id").alias("_kept")), "kept")
    own = {c: f"_keep_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(F.col("doc_id").cast("long").alias("_key"), *[F.col(f"`{c}`").alias(n) for c, n in own.items()], text_or_empty().alias("_text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    found = named.mapInArrow(_with_set_id, f"{kinds}, _set bigint")
    same = F.col("_key").eqNullSafe(F.col("_doc")) & F.col("_set").eqNullSafe(F.col("_kept"))
    found = found.join(broadcast_if_small(kept), same, "left_semi").dropDuplicates(["_key", "_set"])
    return found.select(*[F.col(n).alias(c) for c, n in own.items()])
