"""The queries of the engine's own operators, each with the SQL that answers the same question."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of queries. Each has QUERIES: name -> (function, SQL or None).
MODULES = ["tabulations", "relations", "programs", "surveys", "records", "places", "layers"]


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        found |= importlib.import_module(f"cohortlab.catalog.{name}").QUERIES
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """READ lineitem, SELECT l_quantity > 10, FREQ l_returnflag."""
    return queries()["freq_selected"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
