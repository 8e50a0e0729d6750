"""All registered queries of the restoration engine and their DuckDB SQL."""

from __future__ import annotations

from glyphmend.plans import further  # noqa: F401  (adds its queries to the catalogue)
from glyphmend.plans.catalogue import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
