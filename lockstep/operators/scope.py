"""Which objects take part in synchronization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.model import OWNED_KINDS, OWNER_API_VERSIONS, TEMPLATE_HASH_LABEL


def namespace_allowed(ns: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    if include:
        return F.coalesce(ns.isin(*include), F.lit(False))
    if exclude:
        return ~F.coalesce(ns.isin(*exclude), F.lit(False))
    return F.lit(True)


def namespace_filter(
    df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), ns: str = "ns"
) -> DataFrame:
    """A non-empty include list decides alone; otherwise excluded namespaces go."""
    return df.where(namespace_allowed(F.col(ns), include, exclude))


def is_owned(kind: Column, owners: Column, labels: Column) -> Column:
    """Whether a workload belongs to another one.

    Only the first owner counts, and having one at all ends the test; a pod
    without owner is owned when it carries a non-empty template hash.
    """
    api = F.try_element_at(owners, F.lit(1))["apiVersion"]
    by_label = (kind == "Pod") & (F.coalesce(F.try_element_at(labels, F.lit(TEMPLATE_HASH_LABEL)), F.lit("")) != "")
    return F.coalesce(
        F.when(~kind.isin(*OWNED_KINDS), F.lit(False))
        .when(F.size(owners) > 0, F.coalesce(api.isin(*OWNER_API_VERSIONS), F.lit(False)))
        .otherwise(by_label),
        F.lit(False),
    )


def owned_filter(
    df: DataFrame, kind: str = "object_kind", owners: str = "owners", labels: str = "labels"
) -> DataFrame:
    return df.where(~is_owned(F.col(kind), F.col(owners), F.col(labels)))


def scope_condition(
    ns: Column,
    owned: Column,
    operator_ns: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> Column:
    """The operator's own namespace always counts; cluster-scoped rows skip the namespace test."""
    name = F.coalesce(ns, F.lit(""))
    return (
        F.when((name != "") & (name == operator_ns), True)
        .when((name != "") & ~namespace_allowed(name, include, exclude), False)
        .otherwise(~owned)
    )


def in_scope(
    df: DataFrame,
    operator_ns: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    ns: str = "ns",
    kind: str = "object_kind",
    owners: str = "owners",
    labels: str = "labels",
) -> DataFrame:
    owned = is_owned(F.col(kind), F.col(owners), F.col(labels))
    return df.where(scope_condition(F.col(ns), owned, operator_ns, include, exclude))


def with_object_fields(df: DataFrame, doc: str = "doc") -> DataFrame:
    """The columns that ``in_scope`` reads, from the document where the input lacks them.

    Of an unreadable or missing document all three are null, and it counts as not owned.
    """
    owner = "array<struct<apiVersion: string>>"
    found = {
        "object_kind": F.get_json_object(doc, "$.kind"),
        "owners": F.from_json(F.get_json_object(doc, "$.metadata.ownerReferences"), owner),
        "labels": F.from_json(F.get_json_object(doc, "$.metadata.labels"), "map<string, string>"),
    }
    return df.withColumns({c: value for c, value in found.items() if c not in df.columns})


def configured_kinds(df: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of configured kinds, and the rest for audit."""
    wanted = kinds.select("kind")
    return df.join(wanted, "kind", "left_semi"), df.join(wanted, "kind", "left_anti")
