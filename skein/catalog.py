"""The registry of named queries and of their SQL."""

from __future__ import annotations

from skein.plans import queries as plans
from skein.plans import trees  # noqa: F401  registers its queries


def queries() -> dict[str, plans.Query]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
