"""Matched studies: 1:1 pairs with McNemar's analysis, and conditional logistic regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import kernels
from cohortlab.functions.missing import blank, finite, yes_no


def classify_sets(df: DataFrame, exposure: str, outcome: str, match: str) -> DataFrame:
    """One row per set: its class, pair type where it is a pair. Classes are tried in order: missing, invalid, size, not one
    case and one control."""
    e, c = yes_no(F.col(f"`{exposure}`").cast("string")), yes_no(F.col(f"`{outcome}`").cast("string"))
    rows = df.where(~blank(F.col(f"`{match}`"))).select(
        F.col(f"`{match}`").alias("set"), e.alias("e"), c.alias("c"), blank(F.col(f"`{exposure}`")).alias("be"), blank(F.col(f"`{outcome}`")).alias("bc"))
    sets = rows.groupBy("set").agg(
        F.count("*").alias("size"), F.max(F.col("be") | F.col("bc")).alias("missing"), F.max(F.col("e").isNull() | F.col("c").isNull()).alias("invalid"),
        F.count(F.when(F.col("c"), 1)).alias("cases"), F.max(F.when(F.col("c"), F.col("e"))).alias("case_exposed"), F.max(F.when(~F.col("c"), F.col("e"))).alias("control_exposed"),
    )
    kind = (
        F.when(F.col("missing"), "missing").when(F.col("invalid"), "invalid").when(F.col("size") != 2, "size").when(F.col("cases") != 1, "not-one-case")
        .when(F.col("case_exposed") & F.col("control_exposed"), "both").when(F.col("case_exposed"), "case-only").when(F.col("control_exposed"), "control-only").otherwise("neither")
    )
    return sets.select("set", "size", kind.alias("class"))


def pairs(df: DataFrame, exposure: str, outcome: str, match: str) -> DataFrame:
    """class, sets: how many sets of each pair type or reason for leaving out."""
    return classify_sets(df, exposure, outcome, match).groupBy("class").agg(F.count("*").alias("sets"))


def mcnemar(tally: DataFrame) -> DataFrame:
    """Odds ratio, limits and tests from the discordant pairs: one row."""
    one = tally.agg(*[F.coalesce(F.sum(F.when(F.col("class") == k, F.col("sets"))), F.lit(0)).alias(n) for n, k in (("b", "case-only"), ("c", "control-only"))])

    def run(batches):
        for rows in batches:
            yield pd.DataFrame([{"b": b, "c": c} | kernels.mcnemar(int(b), int(c)) for b, c in zip(rows.b, rows.c)])

    return one.mapInPandas(run, "b long, c long, odds_ratio double, low double, high double, chi2 double, chi2_corrected double, exact_two double, mid_p_two double")


def plausible_match_fields(df: DataFrame, outcome: str, fields: list[str]) -> DataFrame:
    """field, sets, pairs_share: how many of a field's groups are one case with one control."""
    out = None
    c = yes_no(F.col(f"`{outcome}`").cast("string"))
    for f in fields:
        sets = df.where(~blank(F.col(f"`{f}`"))).groupBy(f"`{f}`").agg(F.count("*").alias("n"), F.count(F.when(c, 1)).alias("k"))
        one = sets.agg(F.lit(f).alias("field"), F.count("*").alias("sets"), F.avg(((F.col("n") == 2) & (F.col("k") == 1)).cast("double")).alias("pairs_share"))
        out = one if out is None else out.unionAll(one)
    return out


def conditional_logistic(df: DataFrame, outcome: str, terms: list[str], match: str, level: float = 0.95, iterations: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """term, coefficient, std_err, odds_ratio, limits, z, p, and the likelihood ratio test's statistic.

    Sets of one case and at least one control enter. Each Newton step is one aggregation over the sets: exponentials are
    summed set by set, so nothing but the gradient and information, p + p^2 numbers, reaches the driver."""
    y = yes_no(F.col(f"`{outcome}`").cast("string"))
    rows = df.select(F.col(f"`{match}`").alias("set"), y.alias("y"), *[finite(df, t).alias(f"x{i}") for i, t in enumerate(terms)])
    k = len(terms)
    whole = F.col("y").isNotNull() & ~blank(F.col("set"))
    for i in range(k):
        whole = whole & F.col(f"x{i}").isNotNull()
    rows = rows.where(whole)
    valid = rows.groupBy("set").agg(F.count(F.when(F.col("y"), 1)).alias("cases"), F.count("*").alias("n")).where("cases = 1 and n > 1").select("set")
    rows = rows.join(valid, "set", "left_semi").persist()

    def step(beta: np.ndarray):
        eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        w = F.exp(F.col("eta"))
        sums = [F.sum(w).alias("s"), F.max(F.when(F.col("y"), F.col("eta"))).alias("ec")]
        for i in range(k):
            sums += [F.sum(w * F.col(f"x{i}")).alias(f"m{i}"), F.max(F.when(F.col("y"), F.col(f"x{i}"))).alias(f"c{i}")]
            sums += [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for j in range(i + 1)]
        sets = rows.withColumn("eta", eta).groupBy("set").agg(*sums)
        total = [F.sum(F.col("ec") - F.ln("s")).alias("l")]
        for i in range(k):
            total.append(F.sum(F.col(f"c{i}") - F.col(f"m{i}") / F.col("s")).alias(f"g{i}"))
            total += [F.sum(F.col(f"q{i}_{j}") / F.col("s") - F.col(f"m{i}") * F.col(f"m{j}") / F.col("s") / F.col("s")).alias(f"h{i}_{j}") for j in range(i + 1)]
        r = sets.agg(*total).first()
        g = np.array([r[f"g{i}"] or 0.0 for i in range(k)])
        h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return r["l"] or 0.0, g, h

    try:
        beta = np.zeros(k)
        start, gradient, information = step(beta)
        value = start
        for _ in range(iterations):
            move = np.linalg.solve(information + 1e-12 * np.eye(k), gradient)
            for _ in range(20):
                after = step(beta + move)
                if after[0] >= value - 1e-12:
                    break
                move = move / 2
            beta = beta + move
            done = abs(after[0] - value) < tolerance
            value, gradient, information = after
            if done:
                break
    finally:
        rows.unpersist()
    errors = np.sqrt(np.diag(np.linalg.inv(information + 1e-12 * np.eye(k))))
    z = kernels.Z[level]
    out = [(t, float(b), float(s), float(np.exp(b)), float(np.exp(b - z * s)), float(np.exp(b + z * s)), float(b / s), kernels.chi_square_p(float(b / s) ** 2), float(2 * (value - start))) for t, b, s in zip(terms, beta, errors)]
    return df.sparkSession.createDataFrame(out, "term string, coefficient double, std_err double, odds_ratio double, low double, high double, z double, p double, lr_chi2 double")
