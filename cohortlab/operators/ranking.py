"""Running sums over an order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.sources.scratch import Cuts


def prefix_sums(df: DataFrame, order: list[str], value: str, up: str, total: str, by: list[str] = []) -> DataFrame:
    """The rows with the sum of ``value`` up to and with each in the given order, and over all rows, of every group of ``by``.
    Rows are dealt by ranges of the order and written; each range is summed on its own, and gets what the ranges before it
    hold. There are as many ranges as shuffle partitions, so the table of their sums is small whatever the rows are."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id())
    dealt = Cuts(spark, "prefix").cut(dealt, "ranges")
    sums = dealt.groupBy("_range", *by).agg(F.sum(value).alias("_s"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    past = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)]
    sums = sums.select(F.col("_range").alias("_of"), *names, (F.sum("_s").over(past) - F.col("_s")).alias("_before"), F.sum("_s").over(whole).alias(total))
    same = F.col("_range") == F.col("_of")
    for i, b in enumerate(by):
        same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn(up, F.sum(value).over(inside)).join(sums, same)
    return out.withColumn(up, F.col(up) + F.col("_before")).drop("_range", "_of", "_before", *[f"_by{i}" for i in range(len(by))])
