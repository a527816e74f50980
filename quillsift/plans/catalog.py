"""The registered queries of the screening operators and their SQL."""

from __future__ import annotations

from quillsift.plans import auditing, documents, evaluation, labelling, profiles, ranking, resumes, scoring, screening, stores, streams  # noqa: F401
from quillsift.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
