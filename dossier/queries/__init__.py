"""Queries of the driver contract with their SQL."""

from __future__ import annotations

from dossier.queries import decisions, displays, flows, ledger, pages, records, relational, runs, texts
from dossier.queries.base import Query

_PARTS = (relational, ledger, texts, pages, decisions, runs, records, displays, flows)


def queries() -> dict[str, Query]:
    return {name: f for part in _PARTS for name, f in part.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.registry.sql.items()}
