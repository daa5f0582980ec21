"""All registered queries, in the order of the families."""

from __future__ import annotations

import importlib

from strikebook.plans.registry import Query

FAMILIES = ("book", "market", "settlement", "validation", "conformance", "clearing", "sources", "streams")


def all_queries() -> list[Query]:
    found: list[Query] = []
    for family in FAMILIES:
        found += importlib.import_module(f"strikebook.plans.{family}").registry.entries
    names = [q.name for q in found]
    if len(set(names)) != len(names):
        raise ValueError("a query name is registered twice")
    return found
