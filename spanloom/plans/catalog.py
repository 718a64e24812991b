"""All queries of the library by operator id, with their DuckDB SQL."""

from __future__ import annotations

from . import aggregates, blocks, filters, intervals, joins, nulls, rankings, scalars, scans, similarity, statistics, streams  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
