"""Near-duplicate vectors: int8 tile products with error bounds, exact products only where they may matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.llm.common import components, stored

#: Vectors in a tile. A task holds two tiles and their product.
TILE = 2048
THRESHOLD = 0.98
#: Products of this many int8 pairs are whole numbers below 2^24, so 32-bit floats hold them exactly.
EXACT_TERMS = 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of what the codes stand for, norm of the rest) of each unit vector.

    The last two are rounded up, so they bound the product of two vectors together with
    the product of their codes.
    """
    scale = np.abs(unit).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.clip(np.rint(unit / scale[:, None]), -127, 127)
    stands = codes * scale[:, None]
    up = 1 + 1e-12 * (unit.shape[1] + 8)
    return (
        codes.astype(np.int8),
        scale,
        np.linalg.norm(stands, axis=1) * up,
        np.linalg.norm(unit - stands, axis=1) * up + 1e-15,
    )


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of two tiles of codes, as exact whole numbers: 32-bit float blocks summed in 64 bits."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_TERMS):
        block = slice(at, at + EXACT_TERMS)
        out += a[:, block].astype(np.float32) @ b[:, block].astype(np.float32).T
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, which changes no digit, so that no square of theirs is too large or too small."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with cosine of ``x[i]`` and ``y[j]`` at least ``threshold``, in double precision.

    Only pairs whose int8 product plus its error bound reaches the threshold are computed in full.
    """
    x, y = _scaled(x), _scaled(y)
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    qx, sx, hx, ex = quantise(x / nx[:, None])
    qy, sy, hy, ey = quantise(y / ny[:, None])
    bound = code_products(qx, qy)
    bound *= sx[:, None]
    bound *= sy[None, :]
    # x.y = (hx + ex).(hy + ey); slack covers rounding of the double arithmetic on either side
    bound += np.outer(hx, ey)
    bound += np.outer(ex, hy + ey) + 1e-9
    i, j = np.nonzero(bound >= threshold)
    keep = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):  # bounded memory
        block = slice(at, at + (1 << 16))
        a, b = i[block], j[block]
        keep[block] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return i[keep], j[keep]


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of a forest that joins what the edges (a, b) join: at most one edge per node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null, infinite or NaN components."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(degrees, forest) of distinct usable vectors (rep, label, vector, copies).

    ``degrees``: (rep, n) with the copies of other linked vectors, in parts to be summed;
    ``forest``: (a, b), links that join whatever all links join, at most one per vector and
    pair of tiles. Only vectors of one label and dimension are compared: tiles of at most
    ``tile`` vectors meet once per pair, each pair in a task group of its own, so a
    label may hold any share of the rows. Pairs never leave their task.
    """
    block = ["label", "d"]
    rows = vectors.withColumn("d", F.size("vector"))
    sizes = rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    tiled = rows.join(sizes, block).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = tiled.select("rep", "label", "d", "vector", "copies", "t", other.alias("o"))
    dealt = dealt.select(
        "rep", "label", "d", "vector", "copies", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"), "t"
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group[group["t"] == group["x"]]
        second = group[group["t"] == group["y"]]
        out = []
        if len(first) and len(second):
            same = group["x"].iat[0] == group["y"].iat[0]
            a, b = np.stack(first["vector"].to_numpy()), np.stack(second["vector"].to_numpy())
            ra, rb = first["rep"].to_numpy(), second["rep"].to_numpy()
            for at in range(0, len(a), tile):  # tiles dealt by hash may be a little larger
                i, j = close_pairs(a[at : at + tile].astype(float), b.astype(float), threshold)
                i = i + at
                if same:
                    i, j = i[i < j], j[i < j]
                ends = np.concatenate([ra[i], rb[j]])
                weight = np.concatenate([second["copies"].to_numpy()[j], first["copies"].to_numpy()[i]])
                if len(ends):
                    nodes, at_node = np.unique(ends, return_inverse=True)
                    n = np.bincount(at_node, weights=weight).astype(np.int64)
                    out.append(pd.DataFrame({"a": nodes, "b": nodes, "n": n}))
                    tree = _spanning(ra[i], rb[j])
                    out.append(pd.DataFrame({"a": ra[i][tree], "b": rb[j][tree], "n": 0}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")

    found = stored(
        dealt.groupBy("label", "d", "x", "y").applyInPandas(run, "a bigint, b bigint, n bigint"), "vector-links"
    )
    return found.where("a = b").select(F.col("a").alias("rep"), "n"), found.where("a != b").select("a", "b")


def near_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``table``: the number of other rows linked to it, its component and whether it is kept.

    Equal vectors of a label are one class, compared once and counted by their number;
    equal ones are linked, their cosine being 1. Rows with an unusable vector or a null
    label link with nothing. Keys are taken as unique; a repeated key counts as one more
    copy and shares its component.
    """
    single = table.schema[vector].dataType.simpleString() == "array<float>"
    number = "float" if single else "double"
    numbers = F.transform(F.col(vector), lambda v: v.cast(number) + F.lit(0.0).cast(number))  # -0 is 0
    rows = table.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), numbers.alias("vector")
    ).withColumn("used", F.coalesce(usable(F.col("vector")), F.lit(False)) & F.col("label").isNotNull())
    digest = F.when(F.col("used"), F.xxhash64("label", "vector"))
    rows = stored(rows.withColumn("digest", digest), "vectors")
    used = rows.where("used")
    classes = used.groupBy("label", "digest", "vector").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )
    classes = stored(classes, "vector-classes")
    degrees, forest = links(classes, threshold)
    linked = degrees.groupBy("rep").agg(F.sum("n").alias("n"))
    groups = components(forest)
    found = (
        classes.join(linked, "rep", "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("label").alias("_label"),
            F.col("digest").alias("_digest"),
            F.col("vector").alias("_vector"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_links"),
            F.coalesce("component", "rep").alias("_component"),
        )
    )
    same = (F.col("digest") == F.col("_digest")) & (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))
    component = F.coalesce("_component", "vec_id")
    return rows.join(found, same, "left").select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
