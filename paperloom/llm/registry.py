"""Queries of this folder: name → (plan, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, tuple[Plan, str | None]] = {}


def llm_query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        LLM_QUERIES[name] = (plan, sql)
        return plan

    return add
