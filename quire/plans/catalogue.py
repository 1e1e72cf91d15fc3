"""All core queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import authority, catalog, enrich, graph, layout, search, text, titles, typography, zones

#: Modules that hold queries; each has QUERIES and ORACLE.
MODULES = (text, catalog, layout, search, graph, enrich, titles, typography, zones, authority)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
