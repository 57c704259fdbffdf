"""The trie of conversation prefixes, its totals rolled up in bands of depths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import broadcast_if_small, stored, text_or_empty

#: Depths in a band. A node goes to that many ancestors at most, and each round takes that many times fewer depths.
BAND = 8
#: Rebuilt conversations take up to SHARED - 1 turns from the first of their FAMILY.
FAMILY, SHARED = 5, 9
#: Ids written to one row before their digest is taken.
IDS_PER_ROW = 50_000
#: The names of a node: two 64-bit hashes of its turns.
NODE = ["p", "q"]


def scanned(df: DataFrame, group: str, order: Sequence[str], bits: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``at``, the place of a row in its ``group`` in ``order``, from 0, and ``bits`` replaced by their running xor.

    ``group`` and ``bits`` are long and not null. Rows are dealt by ranges of (group, order), so
    that one group may fill many tasks. Each task scans its own rows batch by batch. Only the group that a task begins
    with can have rows before it; what it brings along comes from one row per task.
    """
    keys = [F.col(group), *[F.col(k) for k in order]]
    names = [f.name for f in df.schema.fields]
    schema = f"{df.schema.simpleString()[7:-1]}, at bigint, _task int, _first boolean, _last boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held, first = None, True  # (group, rows, bits) so far; whether the task's first group goes on

        def rows(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            nonlocal held, first
            own = batch.column(names.index(group)).to_numpy()
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            which = np.cumsum(np.bincount(starts, minlength=len(own))) - 1
            goes_on = held is not None and held[0] == own[0]
            at = np.arange(len(own)) - starts[which]
            if goes_on:
                at[which == 0] += held[1]
            running = []
            for k, name in enumerate(bits):
                x = np.bitwise_xor.accumulate(batch.column(names.index(name)).to_numpy())
                before = np.where(starts > 0, x[starts - 1], 0)
                if goes_on:
                    before[0] ^= held[2][k]
                running.append(x ^ before[which])
            first = first and (held is None or goes_on)
            in_first = (which == 0) & first
            if len(starts) > 1:
                first = False
            held = (own[-1], int(at[-1]) + 1, [int(x[-1]) for x in running])
            ends = np.zeros(len(own), bool)
            ends[-1] = last
            columns = [pa.array(running[bits.index(n)]) if n in bits else batch.column(i) for i, n in enumerate(names)]
            columns += [pa.array(at), pa.array(np.full(len(own), task, np.int32)), pa.array(in_first), pa.array(ends)]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "at", "_task", "_first", "_last"])

        waiting = None
        for batch in batches:
            if len(batch):
                if waiting is not None:
                    yield rows(waiting, False)
                waiting = batch
        if waiting is not None:
            yield rows(waiting, True)

    local = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(scan, schema), "scanned")
    # one row per task: what its last group has so far, and whether that is the group it began with
    ends = local.where("_last").select("_task", group, "at", "_first", *bits).toPandas().sort_values("_task")
    carried, held = [], None
    for task, last, at, whole, *xor in ends.itertuples(index=False, name=None):
        if held:
            carried.append((task, *held))
        if whole and held and held[0] == last:
            held = (last, held[1] + at + 1, *[a ^ b for a, b in zip(held[2:], xor)])
        else:
            held = (last, at + 1, *xor)
    kinds = "".join(f", _x{k} bigint" for k in range(len(bits)))
    table = df.sparkSession.createDataFrame(
        [tuple(map(int, row)) for row in carried], f"_t int, _g bigint, _n bigint{kinds}"
    )
    same = (F.col("_task") == F.col("_t")) & (F.col(group) == F.col("_g")) & F.col("_first")
    both = local.join(F.broadcast(table), same, "left")
    added = {n: F.col(n).bitwiseXOR(F.coalesce(f"_x{k}", F.lit(0))).alias(n) for k, n in enumerate(bits)}
    return both.select(*[added.get(n, F.col(n)) for n in names], (F.col("at") + F.coalesce("_n", F.lit(0))).alias("at"))


def _turn_hash(seed: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn_p, turn_q, size) of every turn: its place, two hashes of role and text, bytes of its text.

    Turns go by ``turn``, null first; those of one number by a hash of role and text. Rows that
    are there twice are two turns, null roles and texts are empty, and rows without a conv_id
    belong to no conversation. Texts are hashed where they are read and don't move.
    """
    role, text = text_or_empty("role"), text_or_empty()
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        _turn_hash("p", role, text).alias("turn_p"),
        _turn_hash("q", text, role).alias("turn_q"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    return scanned(rows, "conv_id", ["turn", "turn_p", "turn_q"]).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv_id, length) of each and (conv_id, at, turn_p, turn_q, size) of its turns.

    Conversation c begins with the first h turns of conversation c - c % FAMILY (all if that has
    fewer, none if it isn't there) and goes on with its own turns after its first h, h being the
    CRC-32 of c in decimal, modulo SHARED. Remainders have the sign of c.
    """
    turns = stored(turns, "turns")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    sizes = stored(sizes.select("conv_id", "own", family.alias("family"), h.alias("h")), "conversations")
    firsts = sizes.where("conv_id = family").select("family", F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = sizes.join(firsts, "family", "left").select("conv_id", "family", "own", "h", taken.alias("taken"))
    convs = stored(convs, "rebuilt")
    # one row per conversation: written, so that a conversation of very many turns is split in the join
    given = turns.where(F.col("at") < SHARED - 1).withColumnRenamed("conv_id", "family")
    given = given.join(broadcast_if_small(convs.select("conv_id", "family", "taken")), "family").where("at < taken")
    kept = turns.join(broadcast_if_small(convs.select("conv_id", "h", "taken")), "conv_id").where("at >= h")
    kept = kept.withColumn("at", F.col("at") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "at", "turn_p", "turn_q", "size"]
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return convs.select("conv_id", length.alias("length")), given.select(columns).unionByName(kept.select(columns))


def passed(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p, q, parent_p, parent_q, size, ends) of every node that every conversation passes, the root included.

    A node's name is the xor of hashes of its turns with their places, in two seeds, 128 bits in all.
    """
    rows = turns.select(
        "conv_id", "at", "size",
        *[_turn_hash(s, F.col("at"), F.col("turn_p"), F.col("turn_q")).alias(n) for s in NODE for n in (s, f"own_{s}")],
    ).withColumnRenamed("at", "place")
    chained = scanned(rows, "conv_id", ["place"], NODE).drop("at")
    below = chained.select(
        "conv_id", (F.col("place") + 1).alias("depth"), *NODE,
        *[F.col(n).bitwiseXOR(F.col(f"own_{n}")).alias(f"parent_{n}") for n in NODE], "size",
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = convs.select(
        "conv_id", zero.alias("depth"), *[zero.alias(n) for n in NODE], *[none.alias(f"parent_{n}") for n in NODE], zero.alias("size")
    )
    return below.unionByName(root)


def _totals(values: DataFrame, sums: Sequence[str]) -> DataFrame:
    return values.groupBy(*NODE).agg(*[F.sum(s).alias(s) for s in sums])


def subtree_sums(nodes: DataFrame, path: DataFrame, sums: Sequence[str], deepest: int, band: int = BAND) -> DataFrame:
    """(p, q, ``sums``): the columns of ``nodes`` (p, q, conv_id, depth, ...) summed over each node's subtree.

    ``path`` has (conv_id, depth, p, q) for every node on the way of the conversation by which a node
    is named. Depths fall into bands of ``band``. A node is exploded to itself and its
    ancestors in its band, which one join by (conversation, band) finds, ``band`` rows meeting
    ``band`` rows at most. That completes all totals but for what hangs below the band. The tops
    of the bands, whose depths are ``band`` times fewer, form a trie that is summed up in the
    same way, and what is then complete at a top goes to its ancestors in the band above it.
    Rounds grow with the logarithm of the depth.
    """
    here = path.select("conv_id", F.col("depth").alias("above"), *NODE, F.floor(F.col("depth") / band).alias("band"))
    from_nodes = nodes.select("conv_id", "depth", F.floor(F.col("depth") / band).alias("band"), *sums)
    inside = from_nodes.join(here, ["conv_id", "band"]).where("above <= depth")
    inside = inside.withColumn("is_top", F.col("above") % band == 0)
    if deepest < band:
        return _totals(inside, sums)
    partial = stored(inside.groupBy(*NODE, "is_top").agg(*[F.sum(s).alias(s) for s in sums]), "band-totals")
    tops = nodes.where(F.col("depth") % band == 0).select(*NODE, "conv_id", F.floor(F.col("depth") / band).alias("depth"))
    tops = stored(tops.join(partial.where("is_top").select(*NODE, *sums), NODE), "band-tops")
    top_path = path.where(F.col("depth") % band == 0).select("conv_id", F.floor(F.col("depth") / band).alias("depth"), *NODE)
    done = stored(subtree_sums(tops, stored(top_path, "top-path"), sums, deepest // band, band), "band-sums")
    # to the ancestors between a top and the one above it
    lowered = tops.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("band"), *NODE).join(done, NODE).drop(*NODE)
    upper = lowered.join(here.where(F.col("above") % band != 0), ["conv_id", "band"]).select(*NODE, *sums)
    rest = partial.where(~F.col("is_top")).select(*NODE, *sums).unionByName(upper)
    return _totals(rest, sums).unionByName(done.select(*NODE, *sums))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(p, q, ends_sha256): of (p, q, conv_id), a digest of each node's conversations in the order of their ids.

    Ids are joined into rows of bounded size where ranges of (node, id) put them; the rows of a
    node are then hashed one after another, so a node with very many ids is never held whole.
    """
    keys = [*NODE, "conv_id"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q, ids = (batch.column(k).to_numpy() for k in range(3))
            new = np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])] if len(p) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            cuts = sorted({*starts.tolist(), *range(0, len(p), IDS_PER_ROW)})
            lists = pa.ListArray.from_arrays(pa.array([*cuts, len(p)], pa.int32()), pc.cast(batch.column(2), pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(p[cuts]), pa.array(q[cuts]), pa.array(ids[cuts]), pc.binary_join(lists, ",")],
                names=[*NODE, "first", "ids"],
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def made(rows: list) -> pa.RecordBatch:
            table = list(zip(*rows)) or [[], [], []]
            types = [pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(table, types)], names=[*NODE, "ends_sha256"])

        for batch in batches:
            out = []
            for p, q, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (p, q) == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (p, q), hashlib.sha256(ids.encode())
            yield made(out)
        if at is not None:
            yield made([(*at, digest.hexdigest())])

    rows = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.mapInArrow(joined, "p bigint, q bigint, first bigint, ids string")
    rows = rows.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return rows.mapInArrow(hashed, "p bigint, q bigint, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, length), whose ``turns`` are (conv_id, at, turn_p, turn_q, size).

    One row per node: ``conv_id``, the smallest member, which names it together with ``depth``;
    ``parent_conv_id``; ``n_convs`` members, ``n_children``, ``n_leaves`` and ``saved_tokens`` of its
    subtree, and ``ends_sha256`` over the conversations that end here. Without conversations there is no node.
    Counts are partial before they are shuffled; members, children and ends of a node may fill many tasks.
    """
    path = stored(passed(convs, turns), "paths")
    nodes = path.groupBy(*NODE, "depth", "parent_p", "parent_q").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size")
    )
    nodes = stored(nodes, "nodes")
    children = nodes.groupBy(F.col("parent_p").alias("p"), F.col("parent_q").alias("q")).agg(F.count(F.lit(1)).alias("n_children"))
    children = stored(children.where("p is not null"), "children")
    named = nodes.join(broadcast_if_small(children), NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = named.select(
        *NODE, "conv_id", "depth",
        (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
    )
    deepest = int(nodes.agg(F.max("depth")).first()[0] or 0)
    names = nodes.select("conv_id").distinct()
    used = path.join(broadcast_if_small(stored(names, "names")), "conv_id", "left_semi").select("conv_id", "depth", *NODE)
    sums = stored(subtree_sums(stored(own, "own"), stored(used, "used-paths"), ["n_leaves", "saved_tokens"], deepest, band), "sums")
    last = path.join(broadcast_if_small(convs), "conv_id").where("depth = length")
    ends = stored(ends_digests(last), "ends")
    parents = nodes.select(F.col("p").alias("parent_p"), F.col("q").alias("parent_q"), F.col("conv_id").alias("parent_conv_id"))
    out = named.join(broadcast_if_small(sums), NODE).join(broadcast_if_small(ends), NODE, "left")
    out = out.join(F.broadcast(parents) if nodes.count() <= 1_000_000 else stored(parents, "parents"), ["parent_p", "parent_q"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: :func:`turns_in_order`, :func:`rebuilt`, :func:`prefix_trie`."""
    convs, turns = rebuilt(turns_in_order(conversations))
    return prefix_trie(convs, turns)
