"""Column functions for kinds, object keys, versions and message lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions import trees
from lockstep.model import BATCH_VERSION


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _join(*parts: Column) -> Column:
    return F.concat_ws("/", *[_text(p) for p in parts])


def kind_text(group: Column, version: Column, resource: Column) -> Column:
    return _join(group, version, resource)


def object_key(kind: Column, ns: Column, name: Column) -> Column:
    """``kind/ns/name``; a missing kind leaves ``/ns/name``."""
    return _join(kind, ns, name)


def event_key(group: Column, version: Column, kind: Column, ns: Column, name: Column) -> Column:
    """Key that changes of one object are debounced on; the uid plays no part."""
    return _join(group, version, kind, ns, name)


def client_key(account: Column, cluster: Column) -> Column:
    return _join(account, cluster)


def connection_key(account: Column, cluster: Column, connection_id: Column) -> Column:
    return _join(account, cluster, connection_id)


def with_identity(df: DataFrame) -> DataFrame:
    """Add every key column whose parts are present."""
    have = set(df.columns)
    added = {}
    if {"kind", "ns", "name"} <= have:
        added["object_key"] = object_key(F.col("kind"), F.col("ns"), F.col("name"))
    if {"kind", "object_kind", "ns", "name"} <= have:
        parts = parse_kind(F.col("kind"))
        added["event_key"] = event_key(
            parts["group"], parts["version"], F.col("object_kind"), F.col("ns"), F.col("name")
        )
    if {"account", "cluster"} <= have:
        added["client_key"] = client_key(F.col("account"), F.col("cluster"))
        if "connection_id" in have:
            added["connection_key"] = connection_key(F.col("account"), F.col("cluster"), F.col("connection_id"))
    return df.withColumns(added)


def parse_kind(text: Column) -> Column:
    """Struct of group, version, resource; null unless there are exactly three parts."""
    parts = F.split(text, "/", -1)
    return F.when(
        F.size(parts) == 3,
        F.struct(parts[0].alias("group"), parts[1].alias("version"), parts[2].alias("resource")),
    )


def identity_from_object(doc: str) -> Column:
    """Lower-cased identity of an object document; null for invalid JSON.

    A bare ``v1`` is both group and version. ``doc`` is a column name or SQL expression.
    """

    def member(v: str, path: str) -> str:
        return f"coalesce(try_variant_get({v}, '$.{path}', 'string'), '')"

    def read(v: str) -> str:
        api = f"split(lower({member(v, 'apiVersion')}), '/', -1)"
        fields = {
            "group": f"{api}[0]",
            "version": f"if(size({api}) = 1, 'v1', try_element_at({api}, 2))",
            "resource": f"lower({member(v, 'kind')})",
            "ns": f"lower({member(v, 'metadata.namespace')})",
            "name": f"lower({member(v, 'metadata.name')})",
            "resource_version": _version_text(member(v, "metadata.resourceVersion")),
        }
        body = ", ".join(f"'{name}', {value}" for name, value in fields.items())
        return f"if({v} IS NULL, NULL, named_struct({body}))"

    return F.expr(trees.let(trees.parsed(doc), read))


def _version_text(value: str) -> str:
    return f"coalesce({trees.integer(value)}, cast(0 AS BIGINT))"


def _integer(text: Column) -> Column:
    """The integer a text holds, null for anything else; surrounding blanks do not count."""
    text = text.cast("string")
    return F.when(text.rlike(trees.INTEGER), text.try_cast("bigint"))


def to_version(text: Column) -> Column:
    """Version as integer, 0 when it is not one."""
    return F.coalesce(_integer(text), F.lit(0).cast("bigint"))


def version_newer(a: Column, b: Column) -> Column:
    """Both sides are integers and ``a`` is the bigger one."""
    return F.coalesce(_integer(a) > _integer(b), F.lit(False))


def semver_order(version: Column) -> Column:
    """Struct that compares as semantic versions do; an invalid version sorts lowest.

    ``v1`` and ``v1.2`` stand for ``v1.0.0`` and ``v1.2.0``; build metadata is ignored.
    """
    number = r"(0|[1-9][0-9]*)"
    ident = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
    full = rf"^v{number}(?:\.{number}(?:\.{number}(-{ident}(?:\.{ident})*)?(?:\+[0-9A-Za-z.-]+)?)?)?\z"
    valid = version.rlike(full)

    def part(i: int) -> Column:
        return F.coalesce(
            F.nullif(F.regexp_extract(version, full, i), F.lit("")).try_cast("decimal(38,0)"),
            F.lit(0).cast("decimal(38,0)"),
        )

    pre = F.regexp_extract(version, full, 4)
    idents = F.transform(
        F.split(F.substring(pre, F.lit(2), F.length(pre)), r"\.", -1),
        lambda t: F.struct(
            (~t.rlike("^[0-9]+$")).alias("word"),
            F.coalesce(F.when(t.rlike("^[0-9]+$"), t.try_cast("decimal(38,0)")), F.lit(0)).alias("number"),
            t.alias("text"),
        ),
    )
    return F.when(
        F.coalesce(valid, F.lit(False)),
        F.struct(
            F.lit(1).alias("valid"),
            part(1).alias("major"),
            part(2).alias("minor"),
            part(3).alias("patch"),
            (pre == "").alias("release"),
            idents.alias("pre"),
        ),
    )


def semver_ge(a: Column, b: Column) -> Column:
    left, right = semver_order(a), semver_order(b)
    return F.when(right.isNull(), True).when(left.isNull(), False).otherwise(left >= right)


def supports_batch(version: Column) -> Column:
    """Whether a client of this version understands batch messages."""
    return F.coalesce((version != "") & semver_ge(version, F.lit(BATCH_VERSION)), F.lit(False))


def derived_id(*parts: Column) -> Column:
    """A message id in UUID form that depends on ``parts`` alone.

    Unlike a random one it survives the recomputation of a lost task.
    """
    digest = F.md5(F.to_json(F.struct(*parts)).cast("binary"))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def lineage(
    df: DataFrame, depth: str = "depth", msg_id: str = "msg_id", new_id: Column | None = None
) -> DataFrame:
    """Lineage of an outgoing message: one level deeper, same id, a new id where none came in.

    ``new_id`` replaces the random id; give one that is derived from the row for
    results that are written more than once.
    """
    fresh = F.uuid() if new_id is None else new_id
    return df.withColumns(
        {depth: F.coalesce(F.col(depth), F.lit(0)) + 1, msg_id: F.coalesce(F.col(msg_id).cast("string"), fresh)}
    )
