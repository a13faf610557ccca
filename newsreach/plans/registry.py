"""Registry of runnable queries, each with its independent SQL where one can be written."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsreach.plans.stand_ins import Roles, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "corpus_queries", "outcome_queries", "effect_queries", "text_queries", "search_queries", "event_queries",
    "evaluation_queries", "source_queries",
)


def query(name: str, sql: str | None = None, roles: str = "") -> Callable:
    """Register a function of :class:`Roles` under ``name``; ``roles`` are the SQL roles that ``sql`` uses."""

    def register(build: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Roles(spark, folder))
        if sql is not None:
            ORACLES[name] = with_roles(roles, sql) if roles else sql.strip()
        return build

    return register


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """All queries and their SQL."""
    for module in MODULES:
        import_module(f"newsreach.plans.{module}")
    return QUERIES, ORACLES


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round floating-point results, whose last digits depend on the order of summation."""
    return df.withColumns({name: F.round(F.col(name).cast("double"), digits) for name in columns})


def joined(array: Column | str) -> Column:
    """Array of texts as one text, for results that are compared as plain values."""
    return F.concat_ws(",", array)
