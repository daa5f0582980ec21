"""Registry of queries: name, Spark plan, comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strikebook.plans.frames import for_duckdb

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None


class Registry:
    def __init__(self) -> None:
        self.entries: list[Query] = []

    def add(self, name: str, sql: str | None = None):
        """Register the decorated plan under ``name`` with its comparison SQL."""

        def register(plan: Plan) -> Plan:
            text = for_duckdb(sql) if sql is not None else None
            self.entries.append(Query(name, plan, text))
            return plan

        return register
