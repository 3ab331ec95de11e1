"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import bills, browse, recipes, records, spelt, standing, texts, vectors

_PLANS = (bills.REGISTRY, browse.REGISTRY, vectors.REGISTRY, texts.REGISTRY, recipes.REGISTRY, standing.REGISTRY, spelt.REGISTRY, records.REGISTRY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plans in _PLANS for name, f in plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plans in _PLANS for name, sql in plans.sql.items()}
