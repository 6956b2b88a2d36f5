"""The list of queries. A query without SQL is one that DuckDB cannot express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewarden.plans.views import with_views

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Plan], Plan]:
    """Registers a plan, and its SQL over the named views."""
    if name in PLANS:
        raise ValueError(f"query {name} is registered twice")

    def register(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = with_views(views, sql)
        return plan

    return register
