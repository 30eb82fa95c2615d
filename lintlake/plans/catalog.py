"""Registry of queries: name -> (Spark plan builder, DuckDB oracle SQL or None).

``query`` registers what runs on the given tables.  ``code_query`` registers what needs a corpus of source files: a table
``code_files(file_id, path, content)`` beside the other tables; the given tables hold none, so these are library functions
with tests of their own and are not part of ``load_all``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}
CODE: dict[str, tuple[QueryFn, str | None]] = {}


def _into(registry: dict[str, tuple[QueryFn, str | None]], name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        registry[name] = (fn, sql)
        return fn

    return deco


def query(name: str, sql: str | None = None):
    """Register a query over the given tables; ``sql`` is the DuckDB oracle (None when not SQL-expressible)."""
    return _into(REGISTRY, name, sql)


def code_query(name: str, sql: str | None = None):
    """Register a query over a corpus of source files."""
    return _into(CODE, name, sql)


def _import() -> None:
    # Importing the modules fills the registries.
    from lintlake.plans import (  # noqa: F401
        q_boundaries,
        q_claims,
        q_contracts,
        q_critics,
        q_facts,
        q_graph,
        q_hotspots,
        q_metrics,
        q_patterns,
        q_repair,
        q_rollup,
        q_structure,
        t_contracts,
        t_findings,
        t_graph,
        t_inference,
        t_metrics,
        t_pages,
        t_streaming,
    )


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    _import()
    return REGISTRY


def load_code() -> dict[str, tuple[QueryFn, str | None]]:
    _import()
    return CODE
