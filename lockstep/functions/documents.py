"""Column functions over nested JSON documents.

A document is JSON text. Its *leaves* are ``array<struct<path, value>>``: one
entry per value that is not a non-empty object, ``path`` an RFC 6901 pointer and
``value`` the canonical JSON text. Arrays are leaves, because a merge patch (RFC
7386) replaces arrays whole; the empty object is a leaf so that it survives. A
merge patch in leaf form uses the value ``null`` for "remove".

Everything here works inside one row, so diffing, patching and hashing need no
shuffle beyond the join that brings two documents together, and a hot key costs
no more than any other row.

Arguments are column names or SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions import trees
from lockstep.model import LEAVES

NO_LEAVES = f"cast(array() AS {LEAVES})"


def parsed(doc: str) -> Column:
    """The document as variant, null for invalid JSON (also when text follows it)."""
    return F.expr(trees.parsed(doc))


def canonical(doc: str) -> Column:
    """Canonical text: members sorted, whitespace gone; null for invalid JSON."""
    return F.expr(trees.canonical(doc))


def is_valid(doc: str) -> Column:
    return F.expr(f"{trees.parsed(doc)} IS NOT NULL")


def json_equal(a: str, b: str) -> Column:
    """Structural equality; invalid JSON is equal to nothing."""
    return F.expr(f"coalesce({trees.canonical(a)} = {trees.canonical(b)}, false)")


def checksum(doc: str, annotation: str | None = None) -> Column:
    """The checksum the document carries, else the digest of its canonical text.

    Null when there is neither, which callers treat as the error case.
    """
    digest = trees.checksum(doc)
    return F.expr(digest if annotation is None else f"coalesce({annotation}, {digest})")


def leaves(doc: str) -> Column:
    """Leaves of a JSON text; null for invalid JSON."""
    return F.expr(trees.leaves(doc))


def struct_leaves(fields: dict[str, str]) -> Column:
    """Leaves of a row with known columns: pointer -> JSON text expression, null = absent."""
    return F.expr(trees.struct_leaves(fields))


def quote(text: str) -> Column:
    """JSON string literal of a text."""
    return F.expr(trees.quote(text))


def leaves_to_json(tree: str) -> Column:
    """JSON text of a document in leaf form; null without leaves."""
    return F.expr(trees.to_json(tree))


def diff(old: str, new: str) -> Column:
    """Merge patch, in leaf form, that turns ``old`` into ``new``; both in leaf form."""
    return F.expr(trees.diff(old, new))


def patch(base: str, change: str) -> Column:
    """``base`` with a merge patch applied; both in leaf form."""
    return F.expr(trees.patch(base, change))


def drop_paths(tree: str, paths: str) -> Column:
    """Leaves without those at or below ``paths``; an emptied object stays as ``{}``."""
    return F.expr(trees.drop_paths(tree, paths))


def clear_paths(tree: str, paths: str) -> Column:
    """Leaves in which what lies at or below ``paths`` is a null member."""
    return F.expr(trees.clear_paths(tree, paths))


def leaf(tree: str, path: str) -> Column:
    """JSON text of one leaf, null when absent."""
    return F.expr(trees.leaf(tree, path))


def mask_containers(value: str) -> Column:
    """Container list, as JSON text, with the values of its environment variables masked."""
    return F.expr(trees.mask_containers(value))


def merge_metadata(old: str, new: str) -> Column:
    """``new`` with the metadata of the stored ``old``; labels and annotations only gain members."""
    return F.expr(trees.merge_metadata(old, new))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a generator.

    Filters on it, or on what is derived from it, then stay above instead of
    being pushed down as a second copy of the expression.
    """
    return df.withColumn(name, F.explode(F.array(value)))
