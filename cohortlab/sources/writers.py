"""Sinks: text files, converted databases with a manifest, and packages for transport."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Header, nulls as empty fields; line ends are single, since the sink takes one character only. One file only if asked
    for: it takes one task."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("duplicate field")
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def convert(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Every table as Parquet under the path, with a manifest: table, fields, records."""
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = df.sparkSession.read.parquet(f"{path}/{name}")
        rows.append((name, len(back.columns), back.count()))
    spark: SparkSession = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame(rows, "table_name string, fields long, records long")
    manifest.write.mode("overwrite").parquet(f"{path}/_migration_manifest")
    return manifest


def package(df: DataFrame, filters: list[tuple[str, str, str]], blanked: list[str]) -> DataFrame:
    """Records that pass every filter (equals, not-equals or contains, whatever the case), some columns blanked."""
    tests = {
        "equals": lambda c, v: F.lower(c) == v.lower(),
        "not-equals": lambda c, v: F.lower(c) != v.lower(),
        "contains": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())),
    }
    fits = reduce(lambda x, y: x & y, [tests[op](F.coalesce(F.col(f).cast("string"), F.lit("")), v) for f, op, v in filters], F.lit(True))
    return df.where(fits).withColumns({c: F.lit("").cast("string") for c in blanked})
