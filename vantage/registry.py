"""Queries over the driver tables, by key, with the SQL that states each independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vantage.plans import audits, graph, health, horizon, identity, matching, reviews, search, store, streams, temporal, text  # noqa: F401
from vantage.plans.catalog import CATALOG
from vantage.sources.views import Views


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG["project_graph"][0](Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(Views(spark, sf_dir))

    return {key: bound(f) for key, (f, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for key, (_, sql) in CATALOG.items() if sql}
