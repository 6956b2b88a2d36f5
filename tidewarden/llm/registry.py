"""The queries of this folder."""

from __future__ import annotations

PLANS: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL if it has one."""

    def register(plan):
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register
