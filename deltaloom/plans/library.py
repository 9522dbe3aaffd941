"""All queries and their SQL: importing a module of queries registers them."""

from __future__ import annotations

from deltaloom.plans import catalogue, choices, code, intents, records  # noqa: F401  they register their queries
from deltaloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
