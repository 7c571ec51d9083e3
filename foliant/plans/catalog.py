"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from foliant.plans import answers, evaluation, pages, search, texts
from foliant.plans.registry import QUERIES, SQL, Query

MODULES = (search, texts, pages, answers, evaluation)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
