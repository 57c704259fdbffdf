"""Queries over the test tables, one per operator, each beside its SQL twin."""

from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

from workload import aggregates, by_client, documents, filters, flows, joins, ordered, projections, streams, tables  # noqa: E402,F401
