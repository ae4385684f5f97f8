"""All queries of the library outside ``llm``, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from inspect import isfunction

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import oracles
from tessera.plans import queries as q

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Public functions of :mod:`tessera.plans.queries`, by name."""
    return {n: f for n, f in vars(q).items() if isfunction(f) and f.__module__ == q.__name__ and not n.startswith("_")}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
