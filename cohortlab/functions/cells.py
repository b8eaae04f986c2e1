"""Statistics of fourfold tables as Column expressions over cell counts a, b (exposed) and c, d (not exposed), where a
and c are cases. One row per table; p-values and exact tests are pandas UDFs over those few rows, the rest is generated code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.functions import kernels
from cohortlab.functions.shapes import DOUBLE, doubles


def ratio(x: Column, y: Column) -> Column:
    return F.when(y != 0, x / y)


def _log_limits(estimate: Column, spread: Column, able: Column, z: float) -> tuple[Column, Column]:
    return tuple(F.when(able, F.exp(F.ln(estimate) + s * z * F.sqrt(spread))) for s in (-1, 1))


def estimates(a: Column, b: Column, c: Column, d: Column, level: float = 0.95) -> dict[str, Column]:
    """Risks, ratios and their limits, and three chi-square statistics. What cannot be computed is null."""
    z = kernels.Z[level]
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n1, n0, m1, m0 = a + b, c + d, a + c, b + d
    n = n1 + n0
    risk1, risk0 = ratio(a, n1), ratio(c, n0)
    odds, risk = ratio(a * d, b * c), ratio(risk1, risk0)
    difference = risk1 - risk0
    full = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    or_low, or_high = _log_limits(odds, ratio(F.lit(1.0), a) + ratio(F.lit(1.0), b) + ratio(F.lit(1.0), c) + ratio(F.lit(1.0), d), full, z)
    rr_low, rr_high = _log_limits(risk, ratio(b, a * n1) + ratio(d, c * n0), (a > 0) & (c > 0), z)
    rd_error = F.sqrt(ratio(risk1 * (1 - risk1), n1) + ratio(risk0 * (1 - risk0), n0))
    x, margins = a * d - b * c, n1 * n0 * m1 * m0
    corrected = F.greatest(F.abs(x) - n / 2, F.lit(0.0))
    return {
        "risk_exposed": risk1, "risk_unexposed": risk0,
        "odds_ratio": odds, "or_low": or_low, "or_high": or_high,
        "risk_ratio": risk, "rr_low": rr_low, "rr_high": rr_high,
        "risk_difference": difference, "rd_low": difference - z * rd_error, "rd_high": difference + z * rd_error,
        "chi2_pearson": ratio(n * x * x, margins), "chi2_mh": ratio((n - 1) * x * x, margins),
        "chi2_yates": ratio(n * corrected * corrected, margins),
    }


@F.pandas_udf(DOUBLE)
def chi2_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([kernels.chi_square_p(s, int(k)) if s == s and k == k else None for s, k in zip(statistic, df)], dtype="float64")


@F.pandas_udf(doubles("fisher_left fisher_right fisher_one fisher_two mid_p_left mid_p_right mid_p_one"))
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kernels.fisher(*map(int, t)) for t in zip(a, b, c, d)])


@F.pandas_udf(doubles("estimate exact_low exact_high mid_low mid_high"))
def conditional_or(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    rows = [kernels.conditional_odds_ratio([tuple(map(int, t))]) for t in zip(a, b, c, d)]
    return pd.DataFrame(rows, columns=["estimate", "exact_low", "exact_high", "mid_low", "mid_high"]).astype("float64")


def stratified_sums() -> dict[str, Column]:
    """Sums over strata, with columns a, b, c, d, from which ``stratified`` takes everything. Empty strata add nothing."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    some = n > 0
    total = lambda x: F.coalesce(F.sum(F.when(some, x)), F.lit(0.0))
    variance = F.when(n > 1, (a + b) * (c + d) * (a + c) * (b + d) / ((n - 1) * n * n)).otherwise(0.0)
    return {
        "r": total(a * d / n), "s": total(b * c / n),
        "p": total((a + d) * a * d / (n * n)), "q": total(((a + d) * b * c + (b + c) * a * d) / (n * n)), "t": total((b + c) * b * c / (n * n)),
        "rr_top": total(a * (c + d) / n), "rr_bottom": total(c * (a + b) / n),
        "rr_spread": total(((a + c) * (a + b) * (c + d) - a * c * n) / (n * n)),
        "x": total((a * d - b * c) / n), "v": total(variance),
        "strata": F.count(F.when(some, 1)),
    }


def stratified(level: float = 0.95) -> dict[str, Column]:
    """Mantel-Haenszel odds and risk ratios with limits (Robins-Breslow-Greenland for the former), and chi-squares."""
    z = kernels.Z[level]
    r, s, p, q, t = (F.col(x) for x in "rspqt")
    odds, risk = ratio(r, s), ratio(F.col("rr_top"), F.col("rr_bottom"))
    odds_spread = p / (2 * r * r) + q / (2 * r * s) + t / (2 * s * s)
    risk_spread = F.col("rr_spread") / (F.col("rr_top") * F.col("rr_bottom"))
    or_low, or_high = _log_limits(odds, odds_spread, (r > 0) & (s > 0), z)
    rr_low, rr_high = _log_limits(risk, risk_spread, (F.col("rr_top") > 0) & (F.col("rr_bottom") > 0), z)
    corrected = F.greatest(F.abs("x") - 0.5, F.lit(0.0))
    return {
        "mh_or": odds, "mh_or_low": or_low, "mh_or_high": or_high, "mh_rr": risk, "mh_rr_low": rr_low, "mh_rr_high": rr_high,
        "mh_chi2": ratio(F.col("x") * F.col("x"), F.col("v")), "mh_chi2_corrected": ratio(corrected * corrected, F.col("v")),
    }


def expected_cell(odds: Column) -> Column:
    """The upper left cell with the stratum's margins and this odds ratio: a root of a quadratic."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n1, m1, n = a + b, a + c, a + b + c + d
    first = 1 - odds
    second = n - n1 - m1 + odds * (n1 + m1)
    third = -odds * n1 * m1
    root = F.sqrt(second * second - 4 * first * third)
    # The root between the bounds, in the form that does not cancel.
    return F.when(F.abs(first) < 1e-12, n1 * m1 / n).otherwise(-2 * third / (second + root))
