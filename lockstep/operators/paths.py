"""Documents as rows of paths: unfold, diff, patch, hash and report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions import documents as docs
from lockstep.functions import trees
from lockstep.model import BOOKKEEPING_PATHS, CLEARED_PATHS, CONTAINER_LISTS, POD_SPEC

KEYS = ["kind", "ns", "name"]
#: Who an object belongs to, where a table holds the objects of several clusters.
CLIENT = ["account", "cluster"]


def object_keys(df: DataFrame) -> list[str]:
    """The columns that identify an object: with account and cluster where the table has both."""
    return [*CLIENT, *KEYS] if set(CLIENT) <= set(df.columns) else KEYS


def store_keys(store: DataFrame, *others: DataFrame) -> list[str]:
    """The keys of a store, which tables that are held against it must have as well.

    A store that keeps the objects of several clients can't be met by rows that don't say whose they are.
    """
    keys = object_keys(store)
    for other in others:
        missing = [c for c in keys if c not in other.columns]
        if missing:
            raise ValueError(f"the store is kept by {', '.join(keys)}; {', '.join(missing)} missing")
    return keys


def telling(keys: Sequence[str]) -> list[str]:
    """The keys, names before kinds and clients.

    Joins sort by their columns in turn, and what many objects share tells few of them apart.
    """
    return list(reversed(keys))


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``a.join(b, keys, how)``, names first; the columns come in the order of ``keys`` all the same."""
    rest = [c for side in (a, b) for c in side.columns if c not in keys]
    return a.join(b, telling(keys), how).select(*keys, *rest)


def to_path_rows(df: DataFrame, keys: Sequence[str] = KEYS, doc: str = "doc") -> DataFrame:
    """One row per leaf."""
    return explode_leaves(df.withColumn("_leaves", docs.leaves(doc)), keys, "_leaves")


def explode_leaves(df: DataFrame, keys: Sequence[str], leaves: str = "leaves") -> DataFrame:
    return df.select(*keys, F.explode(leaves).alias("_x")).select(*keys, "_x.path", "_x.value")


def diff_documents(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = KEYS,
    doc: str = "doc",
    how: str = "inner",
) -> DataFrame:
    """Merge patch per key: ``change`` in leaf form, beside both sides as leaves.

    Documents travel whole, once, and are unfolded where they meet; equal ones
    are not unfolded at all.
    """
    both = old.select(*keys, F.col(doc).alias("_old")).join(
        new.select(*keys, F.col(doc).alias("_new")), list(keys), how
    )
    unfolded = {
        f"{side}_leaves": F.expr(
            f"if(_old <=> _new, {docs.NO_LEAVES}, coalesce({trees.leaves(f'_{side}')}, {docs.NO_LEAVES}))"
        )
        for side in ("old", "new")
    }
    return docs.once(both.withColumns(unfolded), "change", docs.diff("old_leaves", "new_leaves")).drop("_old", "_new")


def diff_rows(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = KEYS,
    doc: str = "doc",
) -> DataFrame:
    """Merge patch as rows: ``set`` with a value, or ``delete``."""
    rows = explode_leaves(diff_documents(old, new, keys, doc), keys, "change")
    gone = F.col("value") == "null"
    return rows.select(
        *keys,
        "path",
        F.when(gone, "delete").otherwise("set").alias("op"),
        F.when(~gone, F.col("value")).alias("value"),
    )


def patch_rows(
    base: DataFrame,
    patches: DataFrame,
    keys: Sequence[str] = KEYS,
    doc: str = "doc",
    patch: str = "patch",
) -> DataFrame:
    """Documents with their merge patch applied, as path rows; no patch, no change."""
    joined = base.select(*keys, F.col(doc).alias("_doc")).join(
        patches.select(*keys, F.col(patch).alias("_patch")), list(keys), "left"
    )
    change = f"coalesce({trees.leaves('_patch')}, {docs.NO_LEAVES})"
    return explode_leaves(
        joined.withColumn("_result", docs.patch(trees.leaves("_doc"), change)), keys, "_result"
    )


def rows_to_json(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Documents put together again from their path rows."""
    tree = F.collect_list(F.struct("path", "value"))
    return rows.groupBy(*keys).agg(tree.alias("_t")).select(*keys, docs.leaves_to_json("_t").alias("doc"))


def rows_checksum(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Checksum of documents in row form; the same number the document itself has."""
    return rows_to_json(rows, keys).select(*keys, docs.checksum("doc").alias("checksum"))


def change_report(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str] = KEYS,
    doc: str = "doc",
) -> DataFrame:
    """How many documents differ, per path and kind of difference."""
    return diff_rows(old, new, keys, doc).groupBy("path", "op").agg(F.count(F.lit(1)).alias("n_objects"))


def _path_list(paths: Sequence[str]) -> str:
    return f"array({', '.join(trees.text(p) for p in paths)})"


def _by_kind(kind: str, table: Mapping[str, list[str]]) -> str:
    """Paths configured for a kind, an empty list for any other kind."""
    cases = [
        f"WHEN {kind} = {trees.text(key)} THEN {_path_list(paths)}"
        if key.startswith("/")
        else f"WHEN endswith({kind}, {trees.text('/' + key)}) THEN {_path_list(paths)}"
        for key, paths in table.items()
    ]
    return f"CASE {' '.join(cases)} ELSE cast(array() AS array<string>) END" if cases else "cast(array() AS array<string>)"


def clean_objects(
    df: DataFrame,
    cleared: Mapping[str, list[str]] = CLEARED_PATHS,
    kind: str = "kind",
    doc: str = "doc",
) -> DataFrame:
    """Objects without bookkeeping, with the paths their kind clears set to null."""
    bare = trees.let(trees.leaves(doc), lambda t: trees.drop_paths(t, _path_list(BOOKKEEPING_PATHS)))
    cleaned = trees.let(
        _by_kind(kind, cleared), lambda paths: trees.let(bare, lambda t: trees.clear_paths(t, paths))
    )
    return df.withColumn(doc, docs.leaves_to_json(cleaned))


def stamp_type(
    df: DataFrame,
    object_kind: str,
    kind: str = "kind",
    doc: str = "doc",
) -> DataFrame:
    """Documents of typed objects with the ``apiVersion`` and ``kind`` they lack.

    ``object_kind`` is a column name or SQL expression.
    """
    api = f"ltrim('/', substring_index({kind}, '/', 2))"
    stamp = trees.struct_leaves({"/apiVersion": trees.quote(api), "/kind": trees.quote(object_kind)})
    return df.withColumn(doc, docs.leaves_to_json(trees.patch(trees.leaves(doc), stamp)))


def mask_env(
    df: DataFrame,
    object_kind: str | None = None,
    doc: str = "doc",
) -> DataFrame:
    """Objects with the values of environment variables masked in every container list.

    The pod spec lies where the object's kind keeps it; kinds without one pass through.
    """
    kind = f"get_json_object({doc}, '$.kind')" if object_kind is None else object_kind
    cases = " ".join(
        f"WHEN {trees.text(name)} THEN {_path_list([f'{top}/{c}' for c in CONTAINER_LISTS])}"
        for name, top in POD_SPEC.items()
    )

    def mask(lists: str) -> str:
        tree = trees.each(
            trees.leaves(doc),
            lambda x: f"if(array_contains({lists}, {x}.path), "
            f"{trees.pair(f'{x}.path', trees.mask_containers(f'{x}.value'))}, {x})",
        )
        return f"if({lists} IS NULL, {doc}, coalesce({trees.to_json(tree)}, {doc}))"

    return df.withColumn(doc, F.expr(trees.let(f"CASE {kind} {cases} END", mask)))


def merge_maps(old: Column, new: Column) -> Column:
    """Union of two maps in which the existing value wins."""
    return F.coalesce(F.map_zip_with(old, new, lambda k, o, n: F.coalesce(o, n)), old, new)
