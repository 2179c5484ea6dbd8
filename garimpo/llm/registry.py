"""The queries of this subpackage. Importing the modules fills the registry."""

from __future__ import annotations

from garimpo.plans.base import Query

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, the text it must agree with."""

    def register(run):
        REGISTRY[name] = Query(run, sql)
        return run

    return register
