"""Complex-sample estimates by Taylor linearisation: FREQ, TABLES and MEANS with strata, sampling units and weights.

Records are reduced to one row per stratum and unit; the variance of an estimate is the sum over strata of
(m sum q^2 - (sum q)^2) / (m - 1), q being the units' sums of its influence. Strata of one unit add nothing, and the
degrees of freedom are units less strata."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import kernels
from cohortlab.functions.cells import ratio
from cohortlab.functions.missing import blank, finite, trimmed
from cohortlab.functions.shapes import DOUBLE
from cohortlab.sources.scratch import Cuts


def design(df: DataFrame, psu: str, stratum: str | None = None, weight: str | None = None, compat: bool = False) -> DataFrame:
    """With h, u and w. Missing weights are left out, or with ``compat`` count as 0 and stay."""
    w = finite(df, weight) if weight else F.lit(1.0)
    rows = df.withColumn("w", F.coalesce(w, F.lit(0.0)) if compat else w)
    rows = rows.withColumns({"h": trimmed(F.col(f"`{stratum}`")) if stratum else F.lit("1"), "u": trimmed(F.col(f"`{psu}`"))})
    return rows.where((F.col("w") >= 0) & ~blank(F.col("u")) & ~blank(F.col("h")))


def variance(rows: DataFrame, influence: Column, by: list[str]) -> DataFrame:
    """Of the estimates that the groups ``by`` name; ``rows`` must have every unit in every group, or a sum of 0 is
    understood for it: ``units`` then tells how many a stratum has."""
    sums = rows.groupBy(*by, "h", "u", "units").agg(F.sum(influence).alias("q"))
    each = sums.groupBy(*by, "h").agg(F.max("units").alias("m"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss"))
    term = F.when(F.col("m") > 1, (F.col("m") * F.col("ss") - F.col("s") * F.col("s")) / (F.col("m") - 1)).otherwise(0.0)
    return each.groupBy(*by).agg(F.greatest(F.sum(term), F.lit(0.0)).alias("variance"))


def units(rows: DataFrame) -> DataFrame:
    """Units per stratum: one row a stratum."""
    return rows.groupBy("h").agg(F.count_distinct("u").alias("units"))


def degrees(rows: DataFrame) -> DataFrame:
    return units(rows).agg((F.sum("units") - F.count("*")).alias("df"))


@F.pandas_udf(DOUBLE)
def t_critical(df: pd.Series) -> pd.Series:
    return pd.Series([kernels.student_t_quantile(float(d)) if d > 0 else None for d in df], dtype="float64")


def _with_limits(out: DataFrame, rows: DataFrame, estimate: str) -> DataFrame:
    """Standard error and limits with the design's degrees of freedom."""
    out = out.join(F.broadcast(degrees(rows).withColumn("t", t_critical(F.col("df").cast("double")))))
    se = F.sqrt("variance")
    return out.withColumns({"std_err": se, "lcl": F.col(estimate) - F.col("t") * se, "ucl": F.col(estimate) + F.col("t") * se}).drop("t", "variance")


def _once(small: DataFrame) -> DataFrame:
    """What the records come down to, written, so that they are read and aggregated once."""
    return Cuts(small.sparkSession, "survey").cut(small, "units")


def freq(df: DataFrame, field: str, psu: str, stratum: str | None = None, weight: str | None = None) -> DataFrame:
    """value, count, weighted, proportion, std_err, limits, design effect of each category."""
    rows = design(df.where(~blank(F.col(f"`{field}`"))), psu, stratum, weight).withColumn("value", trimmed(F.col(f"`{field}`")))
    # One row for each stratum, unit and category; the categories' influence on a share p is (I - p) w / W.
    small = _once(rows.groupBy("h", "u", "value").agg(F.sum("w").alias("w"), F.count("*").alias("n")))
    per_unit = small.groupBy("h", "u").agg(F.sum("w").alias("wu"))
    total = small.agg(F.sum("w").alias("wt"), F.sum("n").alias("nt"))
    shares = small.groupBy("value").agg(F.sum("n").alias("count"), F.sum("w").alias("weighted")).join(F.broadcast(total))
    shares = shares.withColumn("proportion", F.col("weighted") / F.col("wt"))
    grid = per_unit.join(F.broadcast(shares.select("value", "proportion", "wt")))  # units x categories
    grid = grid.join(small.select("h", "u", "value", "w"), ["h", "u", "value"], "left").join(units(small), "h")
    influence = (F.coalesce("w", F.lit(0.0)) - F.col("proportion") * F.col("wu")) / F.col("wt")
    out = shares.join(variance(grid, influence, ["value"]), "value")
    simple = F.col("proportion") * (1 - F.col("proportion")) / (F.col("nt") - 1)
    out = _with_limits(out.withColumn("design_effect", ratio(F.col("variance"), simple)), small, "proportion")
    return out.select("value", "count", "weighted", "proportion", "std_err", "lcl", "ucl", "design_effect", "df")


def tables(df: DataFrame, exposure: str, outcome: str, psu: str, stratum: str | None = None, weight: str | None = None) -> DataFrame:
    """Each cell: count, row and column shares, standard error, limits and design effect of the row share."""
    keep = reduce(lambda x, y: x & y, [~blank(F.col(f"`{c}`")) for c in (exposure, outcome)])
    rows = design(df.where(keep), psu, stratum, weight).withColumns({"e": trimmed(F.col(f"`{exposure}`")), "o": trimmed(F.col(f"`{outcome}`"))})
    small = _once(rows.groupBy("h", "u", "e", "o").agg(F.sum("w").alias("w"), F.count("*").alias("n")))
    row_units = small.groupBy("h", "u", "e").agg(F.sum("w").alias("wu"))
    cells_ = small.groupBy("e", "o").agg(F.sum("w").alias("wc"), F.sum("n").alias("count"))
    row = small.groupBy("e").agg(F.sum("w").alias("wr"), F.sum("n").alias("nr"))
    col = small.groupBy("o").agg(F.sum("w").alias("wk"))
    cells_ = cells_.join(F.broadcast(row), "e").join(F.broadcast(col), "o")
    cells_ = cells_.withColumns({"row_share": F.col("wc") / F.col("wr"), "col_share": F.col("wc") / F.col("wk")})
    grid = row_units.join(F.broadcast(cells_.select("e", "o", "row_share", "wr")), "e")
    grid = grid.join(small.select("h", "u", "e", "o", "w"), ["h", "u", "e", "o"], "left").join(units(small), "h")
    influence = (F.coalesce("w", F.lit(0.0)) - F.col("row_share") * F.col("wu")) / F.col("wr")
    out = cells_.join(variance(grid, influence, ["e", "o"]), ["e", "o"])
    simple = F.col("row_share") * (1 - F.col("row_share")) / (F.col("nr") - 1)
    out = _with_limits(out.withColumn("design_effect", ratio(F.col("variance"), simple)), small, "row_share")
    return out.select(F.col("e").alias("exposure"), F.col("o").alias("outcome"), "count", "row_share", "col_share", "std_err", "lcl", "ucl", "design_effect")


def means(df: DataFrame, field: str, psu: str, stratum: str | None = None, weight: str | None = None, domain: str | None = None) -> DataFrame:
    """[domain,] count, mean, standard error, limits, least and largest value."""
    own = ["domain"] if domain else []
    rows = design(df, psu, stratum, weight).withColumn("x", finite(df, field)).where("x is not null")
    if domain:
        rows = rows.where(~blank(F.col(f"`{domain}`"))).withColumn("domain", trimmed(F.col(f"`{domain}`")))
    small = _once(rows.groupBy("h", "u", *own).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")))
    whole = small.groupBy(*own).agg(F.sum("w").alias("wt"), (F.sum("wx") / F.sum("w")).alias("mean"), F.sum("n").alias("count"), F.min("least").alias("min"), F.max("most").alias("max"))
    grid = small.join(F.broadcast(whole.select(*own, "wt", "mean")), own) if own else small.join(F.broadcast(whole.select("wt", "mean")))
    grid = grid.join(units(small), "h")
    spread = variance(grid, (F.col("wx") - F.col("mean") * F.col("w")) / F.col("wt"), own)
    out = whole.join(spread, own) if own else whole.join(F.broadcast(spread))
    return _with_limits(out, small, "mean").select(*own, "count", "mean", "std_err", "lcl", "ucl", "min", "max")
