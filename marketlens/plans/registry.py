"""Named queries and the SQL each one must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import derived_as_cte, with_dependencies

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``uses`` names derived tables its SQL reads."""
    derived_tables = with_dependencies(uses)

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ctes = ",\n".join(derived_as_cte(u) for u in derived_tables)
            body = oracle.strip()
            if ctes:
                head = re.match(r"with( recursive)?\s+", body)
                rest = f",\n{body[head.end():]}" if head else f"\n{body}"
                body = f"with{head[1] or '' if head else ''} {ctes}{rest}"
            ORACLES[name] = body
        return fn

    return register
