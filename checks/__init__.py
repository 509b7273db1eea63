"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from checks import aggregates, catalogs, generators, jobs, joins, metrics, projections, regions, sources, streams, windows  # noqa: F401
from checks.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
