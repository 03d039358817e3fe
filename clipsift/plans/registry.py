"""All queries of the engine and their SQL.

``query`` registers a function of (spark, sf_dir); ``sql`` is the same result in DuckDB's SQL over the same tables, with the
bridges of ``bridges_sql`` as common table expressions where it names them in ``{braces}``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            from clipsift.plans.bridges_sql import with_bridges

            ORACLE_SQL[name] = with_bridges(sql)
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from clipsift.plans import q_clips, q_extra, q_feedback, q_joins, q_metrics, q_models, q_more, q_scores, q_sequence, q_sources, q_state, q_text, q_vectors  # noqa: F401


load()
