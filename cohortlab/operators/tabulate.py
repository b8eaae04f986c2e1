"""Tabulations: FREQ, TABLES, MEANS, SUMMARIZE, rates and epidemic curves.

Each reduces the records in one aggregation on the cluster; everything after that works on its small result.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions import cells, kernels
from cohortlab.functions.missing import blank, empty, finite, trimmed
from cohortlab.functions.shapes import doubles
from cohortlab.operators.ranking import prefix_sums
from cohortlab.sources.scratch import Cuts

#: Fixed value: the quantile that frequency limits use.
FREQ_Z = 1.96
EXACT_BELOW = 300
#: Categories that one task may order; more are summed by ranges.
ONE_TASK = 100_000
#: Cells of all tables of one TABLES; more are an error, since empty cells are listed too.
MOST_CELLS = 5_000_000
#: Texts that stand for yes and no.
YES, NO = ("yes", "true", "1"), ("no", "false", "0")


def category(df: DataFrame, name: str) -> Column:
    """A value as the category it is listed under: rank of its type, number, text. Truth values read Yes and No."""
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType.typeName()
    if kind == "boolean":
        text, number, rank = F.when(c, "Yes").otherwise("No"), F.lit(None).cast("double"), F.lit(1)
    elif kind in ("string", "date", "timestamp"):
        text, number, rank = trimmed(c), F.lit(None).cast("double"), F.lit(2)
    else:
        number, rank = c.cast("double"), F.lit(0)
        text = F.when(number == F.floor(number), F.format_string("%d", number.cast("long"))).otherwise(number.cast("string"))
    missing = blank(c)
    return F.struct(
        F.when(missing, 3).otherwise(rank).alias("rank"),
        F.when(~missing, number).alias("number"),
        F.when(~missing, text).alias("text"),
    )


@F.pandas_udf(doubles("low high"))
def _exact_limits(count: pd.Series, total: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kernels.clopper_pearson(int(x), int(n)) for x, n in zip(count, total)], columns=["low", "high"])


def freq(df: DataFrame, field: str, stratum: str | None = None, with_missing: bool = False, limits: bool = True) -> DataFrame:
    """[stratum,] value, is_missing, count, proportion, cumulative, low, high. Numbers come before truth values before
    texts before missing. Limits are Wilson's from 300 records on, exact below."""
    keys = [category(df, field).alias("value")]
    if stratum:
        df = df.where(~blank(F.col(f"`{stratum}`")))
        keys.insert(0, F.col(f"`{stratum}`").alias("stratum"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("count"))
    if not with_missing:
        counts = counts.where(F.col("value.rank") < 3)
    own = ["stratum"] if stratum else []
    counts = Cuts(df.sparkSession, "freq").cut(counts, "counts")
    n = F.col("total").cast("double")
    p = F.col("count") / n
    if counts.count() > ONE_TASK:
        out = prefix_sums(counts, ["value"], "count", "up_to", "total", own)
    else:
        all_rows = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))
        up_to = all_rows.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = counts.withColumns({"total": F.sum("count").over(all_rows), "up_to": F.sum("count").over(up_to)})
    out = out.withColumns({"proportion": p, "cumulative": F.col("up_to") / n})
    z2 = FREQ_Z * FREQ_Z
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), FREQ_Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    whole = F.col("count") == F.col("total")
    columns = [*own, F.coalesce("value.text", F.lit("")).alias("value"), (F.col("value.rank") == 3).alias("is_missing"), "count", "proportion", "cumulative"]
    if not limits:
        return out.select(*columns)
    out = out.withColumn("exact", F.when(n < EXACT_BELOW, _exact_limits("count", "total")))
    low = F.when(n < EXACT_BELOW, F.col("exact.low")).when(whole, 1.0).otherwise(middle - half)
    high = F.when(n < EXACT_BELOW, F.col("exact.high")).when(whole, 1.0).otherwise(middle + half)
    return out.select(*columns, low.alias("low"), high.alias("high"))


def category_order(c: Column, binary: bool) -> Column:
    """What listed categories sort by: numbers by value, then texts whatever the case; of yes and no, yes is first."""
    number = F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), c.cast("double"))
    low = F.lower(c)
    rank = F.when(low.isin(*YES), 0).when(low.isin(*NO), 1).otherwise(2) if binary else F.lit(2)
    return F.struct(rank.alias("rank"), number.isNull().alias("text"), number.alias("number"), low.alias("low"), c.alias("as_is"))


def tables(df: DataFrame, exposure: str, outcome: str, strata: list[str] = [], weight: str | None = None, with_missing: bool = False, one_is_yes: bool = False) -> DataFrame:
    """Every cell of the M x N tables: strata, exposure, outcome, count, row and column totals, percentages, expected
    count, and the cell's row and column (from 0). Categories are those of all records, so empty cells appear as 0. Truth
    values, and with ``one_is_yes`` whatever reads like them, list yes first, so that row 0 is exposed and column 0 a case."""
    label = lambda c: F.when(blank(F.col(f"`{c}`")), F.lit("(.)")).otherwise(trimmed(F.col(f"`{c}`")) if df.schema[c].dataType.typeName() == "boolean" else category(df, c)["text"])
    binary = lambda c: one_is_yes or df.schema[c].dataType.typeName() == "boolean"
    if not with_missing:
        df = df.where(reduce(lambda x, y: x & y, [~blank(F.col(f"`{c}`")) for c in (exposure, outcome, *strata)]))
    value = F.lit(1)
    if weight:
        df = df.withColumn("_w", finite(df, weight)).where(F.col("_w") >= 0)
        value = F.col("_w")
    keys = {exposure: "exposure", outcome: "outcome"} | {s: s for s in strata}
    counts = df.groupBy(*[label(c).alias(n) for c, n in keys.items()]).agg(F.sum(value).alias("count"))
    counts = Cuts(df.sparkSession, "tables").cut(counts, "counts")
    listed = counts.agg(*[F.count_distinct(n).alias(n) for n in keys.values()]).first()
    if reduce(lambda x, y: x * y, listed, 1) > MOST_CELLS:
        raise ValueError(f"the tables would have over {MOST_CELLS} cells: " + ", ".join(f"{n} {k}" for n, k in zip(keys.values(), listed)))

    def side(name: str, place: str, c: str) -> DataFrame:
        first = Window.partitionBy(F.lit(0)).orderBy(category_order(F.col(name), binary(c)))
        return counts.select(name).distinct().withColumn(place, F.row_number().over(first) - 1)

    # At most MOST_CELLS cells: the sides are the categories just counted.
    grid = side("exposure", "row", exposure).join(side("outcome", "col", outcome))
    for s in strata:
        grid = grid.join(counts.select(s).distinct())
    cells_ = grid.join(counts, [*strata, "exposure", "outcome"], "left").na.fill(0, ["count"])
    over = lambda *c: F.sum("count").over(Window.partitionBy(*strata, *c) if strata or c else Window.partitionBy(F.lit(0)))
    cells_ = cells_.withColumns({"row_total": over("exposure"), "col_total": over("outcome"), "total": over()})
    return cells_.select(
        *strata, "exposure", "outcome", "row", "col", "count", "row_total", "col_total", "total",
        cells.ratio(100.0 * F.col("count"), F.col("row_total")).alias("row_pct"),
        cells.ratio(100.0 * F.col("count"), F.col("col_total")).alias("col_pct"),
        cells.ratio(F.col("row_total") * F.col("col_total"), F.col("total").cast("double")).alias("expected"),
    )


def fisher_tables(cells_: DataFrame, strata: list[str] = [], most: int = 200_000) -> DataFrame:
    """Fisher-Freeman-Halton p of each M x N table (null where more than ``most`` tables have its margins, or it has fewer
    than two rows or columns that are not empty). One task per stratum, of the cells that ``tables`` bounds."""
    used = cells_.where((F.col("row_total") > 0) & (F.col("col_total") > 0)).select(*strata, "row", "col", F.col("count").cast("long").alias("count"))
    kind = ", ".join([f"`{s}` {cells_.schema[s].dataType.simpleString()}" for s in strata] + ["fisher_p double", "n_rows int", "n_cols int"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        grid = part.pivot(index="row", columns="col", values="count").fillna(0).astype(int)
        able = min(grid.shape) > 1
        p = kernels.freeman_halton(grid.values.tolist(), most) if able else None
        return pd.DataFrame([(*[part[s].iloc[0] for s in strata], p, *grid.shape)], columns=[*strata, "fisher_p", "n_rows", "n_cols"])

    return used.withColumn("_one", F.lit(0)).groupBy("_one", *strata).applyInPandas(run, kind)


def fourfold_of(cells_: DataFrame, strata: list[str] = []) -> DataFrame:
    """a, b, c, d of each 2 x 2 table, by the order of its categories."""
    at = lambda r, c: F.sum(F.when((F.col("row") == r) & (F.col("col") == c), F.col("count")).otherwise(0))
    return cells_.groupBy(*strata).agg(at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c"), at(1, 1).alias("d"))


def outtable(cells_: DataFrame, exposure: str, strata: list[str] = []) -> DataFrame:
    """The table that OUTTABLE names."""
    return cells_.select(*strata, F.col("exposure").alias("EXPOSURE"), F.col("outcome").alias("OUTCOME"), F.lit(exposure).alias("VARNAME"), F.col("count").alias("COUNT"))


def pearson(cells_: DataFrame, strata: list[str] = []) -> DataFrame:
    """Chi-square of each M x N table over its rows and columns that are not empty, with p and sparseness."""
    used = cells_.where((F.col("row_total") > 0) & (F.col("col_total") > 0))
    gap = F.col("count") - F.col("expected")
    out = used.groupBy(*strata).agg(
        F.sum(gap * gap / F.col("expected")).alias("chi2"),
        ((F.count_distinct("exposure") - 1) * (F.count_distinct("outcome") - 1)).alias("df"),
        F.min("expected").alias("least_expected"),
    )
    return out.withColumn("p", F.when(F.col("df") > 0, cells.chi2_p("chi2", "df")))


def fourfold(df: DataFrame, exposed: Column, case: Column, strata: list[str] = []) -> DataFrame:
    """a, b, c, d of each stratum, from two conditions; records where either is null are left out."""
    rows = df.withColumns({"_e": exposed, "_c": case}).where("_e is not null and _c is not null")
    for s in strata:
        rows = rows.where(~blank(F.col(f"`{s}`")))
    tally = lambda e, c: F.count(F.when((F.col("_e") == e) & (F.col("_c") == c), 1))
    return rows.groupBy(*strata).agg(tally(True, True).alias("a"), tally(True, False).alias("b"), tally(False, True).alias("c"), tally(False, False).alias("d"))


def fourfold_analysis(cells_: DataFrame, level: float = 0.95, exact: bool = True) -> DataFrame:
    """Estimates, limits, chi-squares with p, and exact values of each fourfold table."""
    out = cells_.withColumns(cells.estimates(F.col("a"), F.col("b"), F.col("c"), F.col("d"), level))
    for name in ("chi2_pearson", "chi2_mh", "chi2_yates"):
        out = out.withColumn(f"p_{name[5:]}", F.when(F.col(name).isNotNull(), cells.chi2_p(name, F.lit(1))))
    if exact:
        out = out.withColumns({"_f": cells.fisher("a", "b", "c", "d"), "_o": cells.conditional_or("a", "b", "c", "d")})
        out = out.select("*", "_f.*", F.col("_o.estimate").alias("conditional_or"), *[F.col(f"_o.{n}").alias(f"cor_{n}") for n in ("exact_low", "exact_high", "mid_low", "mid_high")])
        out = out.drop("_f", "_o")
    return out


def stratified(cells_: DataFrame, level: float = 0.95) -> DataFrame:
    """Mantel-Haenszel summaries and homogeneity tests over strata of a, b, c, d."""
    sums = cells_.agg(*[c.alias(n) for n, c in cells.stratified_sums().items()]).withColumns(cells.stratified(level))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    odds = F.col("mh_or")
    with_odds = cells_.join(F.broadcast(sums.select("mh_or")))  # one row
    e = cells.expected_cell(odds)
    n1, m1, n = a + b, a + c, a + b + c + d
    rest = [e, n1 - e, m1 - e, n - n1 - m1 + e]
    variance = 1 / sum(1 / x for x in rest)
    able = reduce(lambda x, y: x & y, [x > 0 for x in rest])
    full = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    log_odds, w = F.ln(a * d / (b * c)), 1 / (1 / a + 1 / b + 1 / c + 1 / d)
    able_rr = (a > 0) & (c > 0) & ((b > 0) | (d > 0))
    log_risk, u = F.ln(a / (a + b) / (c / (c + d))), 1 / (b / (a * (a + b)) + d / (c * (c + d)))
    steps = with_odds.where(n > 0).select(
        F.when(able, (a - e) * (a - e) / variance).alias("term"), F.when(able, a - e).alias("gap"), F.when(able, variance).alias("var"),
        F.when(full, w).alias("w"), F.when(full, w * log_odds).alias("wl"), F.when(full, w * log_odds * log_odds).alias("wll"),
        F.when(able_rr, u).alias("u"), F.when(able_rr, u * log_risk).alias("ul"), F.when(able_rr, u * log_risk * log_risk).alias("ull"),
    )
    tests = steps.agg(
        F.count("*").alias("n_strata"), F.count("term").alias("n_able"), F.sum("term").alias("bd"), F.sum("gap").alias("gap"), F.sum("var").alias("var"),
        F.count("w").alias("n_full"), F.sum("w").alias("sw"), F.sum("wl").alias("swl"), F.sum("wll").alias("swll"),
        F.count("u").alias("n_rr"), F.sum("u").alias("su"), F.sum("ul").alias("sul"), F.sum("ull").alias("sull"),
    )
    every = F.col("n_able") == F.col("n_strata")
    tests = tests.select(
        F.when(every, F.col("bd")).alias("breslow_day"),
        F.when(every, F.col("bd") - F.col("gap") * F.col("gap") / F.col("var")).alias("tarone"),
        F.when(F.col("n_full") == F.col("n_strata"), F.col("swll") - F.col("swl") * F.col("swl") / F.col("sw")).alias("woolf"),
        F.when(F.col("n_rr") == F.col("n_strata"), F.col("sull") - F.col("sul") * F.col("sul") / F.col("su")).alias("woolf_rr"),
        (F.col("n_strata") - 1).alias("df"),
    )
    return sums.select("strata", *cells.stratified(level)).join(F.broadcast(tests))


def stratified_exact(cells_: DataFrame) -> DataFrame:
    """Conditional odds ratio common to all strata of a, b, c, d, with limits: one row, from the few rows of the strata."""
    names = ["estimate", "exact_low", "exact_high", "mid_low", "mid_high"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = kernels.conditional_odds_ratio([tuple(map(int, r)) for r in part[["a", "b", "c", "d"]].values])
        return pd.DataFrame([found], columns=names).astype("float64")

    return cells_.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, doubles(" ".join(names)))


def trend(cells_: DataFrame, score: str) -> DataFrame:
    """Extended Mantel-Haenszel chi-square for trend over rows of (score, cases, controls)."""
    x, a, n = F.col(score).cast("double"), F.col("cases").cast("double"), (F.col("cases") + F.col("controls")).cast("double")
    s = cells_.agg(
        F.sum(a * x).alias("t1"), F.sum(n * x).alias("t2"), F.sum(n * x * x).alias("t3"), F.sum(a).alias("k"), F.sum(n).alias("n")
    )
    gap = F.col("t1") - F.col("k") * F.col("t2") / F.col("n")
    spread = F.col("k") * (F.col("n") - F.col("k")) * (F.col("n") * F.col("t3") - F.col("t2") * F.col("t2"))
    scaled = spread / (F.col("n") * F.col("n") * (F.col("n") - 1))
    return s.select(cells.ratio(gap * gap, scaled).alias("chi2_trend"))


def trend_rows(cells_: DataFrame, score: str) -> DataFrame:
    """score, cases, controls, odds_ratio against the row with the lowest score (null where that cannot be computed)."""
    base = cells_.agg(F.min_by(F.struct("cases", "controls"), score).alias("_b"))  # one row
    top, bottom = F.col("cases") * F.col("_b.controls"), F.col("controls") * F.col("_b.cases")
    return cells_.join(F.broadcast(base)).select(score, "cases", "controls", cells.ratio(top.cast("double"), bottom.cast("double")).alias("odds_ratio"))


def means(df: DataFrame, field: str, by: list[str] = []) -> DataFrame:
    """n, total, mean, variance, sd, min, quartiles, max, mode (lowest of equals). A quartile is the mean of both
    neighbours where n p is whole, else the next value: of the least value up to which there are n p records or more,
    and the greatest before which there are n p or fewer. Both come from running sums over the counted values."""
    x = F.col("x")
    names = [f"g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{b}`").alias(n) for b, n in zip(by, names)], finite(df, field).alias("x")).where("x is not null")
    plain = rows.groupBy(*names).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
    )
    counts = rows.groupBy(*names, "x").agg(F.count("*").alias("k"))
    ranked = prefix_sums(counts, ["x"], "k", "up", "all", names)
    need = lambda p: F.col("all") * p
    quartile = lambda p: (F.min(F.when(F.col("up") >= need(p), x)) + F.max(F.when(F.col("up") - F.col("k") <= need(p), x))) / 2
    best = F.max_by(x, F.struct("k", (-x).alias("low"))).alias("mode")
    order = ranked.groupBy(*[F.col(n).alias(f"_{n}") for n in names]).agg(quartile(0.25).alias("q25"), quartile(0.5).alias("median"), quartile(0.75).alias("q75"), best)
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], F.lit(True))
    both = plain.join(order, same)
    return both.select(*[F.col(n).alias(b) for n, b in zip(names, by)], "n", "total", "mean", "variance", "sd", "min", "q25", "median", "q75", "max", "mode")


def summarize(df: DataFrame, aggregates: list[tuple[str, str, str | None]], strata: list[str] = [], order: list[str] = [], weight: str | None = None) -> DataFrame:
    """aggregates: (result, function, field). FIRST and LAST go by ``order``, or by all fields from left to right, so that
    partitions do not matter. COUNT without a field counts records; white space is a value, the empty text is not. A
    null stratum is a group of its own."""
    position = F.struct(*[F.col(f"`{o}`") for o in order or df.columns])
    w = finite(df, weight) if weight else None

    def build(function: str, field: str | None) -> Column:
        if field is None:
            return F.count("*") if w is None else F.coalesce(F.sum(w), F.lit(0.0))
        c = F.col(f"`{field}`")
        value = F.when(~empty(c), c)
        x = finite(df, field)
        if w is not None and function in ("SUM", "AVG", "COUNT"):
            mass = F.sum(F.when(x.isNotNull(), w))
            return {"SUM": F.sum(x * w), "COUNT": F.coalesce(mass, F.lit(0.0)), "AVG": cells.ratio(F.sum(x * w), mass)}[function]
        plain = {
            "AVG": lambda: F.avg(x), "SUM": lambda: F.sum(x), "MIN": lambda: F.min(value), "MAX": lambda: F.max(value), "COUNT": lambda: F.count(value),
            "STDEV": lambda: F.stddev_samp(x), "STDEVP": lambda: F.stddev_pop(x), "VAR": lambda: F.var_samp(x), "VARP": lambda: F.var_pop(x),
            "FIRST": lambda: F.min_by(value, F.when(value.isNotNull(), position)), "LAST": lambda: F.max_by(value, F.when(value.isNotNull(), position)),
        }
        return plain[function.upper()]()

    return df.groupBy(*strata).agg(*[build(f, field).alias(name) for name, f, field in aggregates])


def rate(df: DataFrame, field: str, value: str, multiplier: float = 100_000, by: list[str] = []) -> DataFrame:
    """Numerator: records whose value equals, whatever the case, among those that have one."""
    c = F.col(f"`{field}`")
    out = df.groupBy(*by).agg(F.count(F.when(~blank(c) & (F.lower(trimmed(c)) == value.strip().lower()), 1)).alias("numerator"), F.count(F.when(~blank(c), 1)).alias("denominator"))
    return out.withColumn("rate", cells.ratio(F.col("numerator") * F.lit(float(multiplier)), F.col("denominator")))


def epi_curve(df: DataFrame, when: str, unit: str = "day", step: int = 1, status: str | None = None) -> DataFrame:
    """Cases by bin of ``step`` units (hour, day, month or year, UTC), empty bins included, by status if asked."""
    ts = F.col(f"`{when}`").cast("timestamp")
    rows = df.where(ts.isNotNull()).select(F.date_trunc(unit, ts).alias("t"), *([F.col(f"`{status}`").alias("status")] if status else []))
    first = rows.agg(F.min("t").alias("first"), F.max("t").alias("last"))  # one row
    rows = rows.join(F.broadcast(first))
    if unit in ("hour", "day"):
        seconds = (3600 if unit == "hour" else 86_400) * step
        bin_ = F.timestamp_seconds(F.unix_timestamp("first") + F.floor((F.unix_timestamp("t") - F.unix_timestamp("first")) / seconds) * seconds)
        every = F.expr(f"interval {step} {unit}")
    else:
        months = step * (12 if unit == "year" else 1)
        gap = (F.year("t") - F.year("first")) * 12 + F.month("t") - F.month("first")
        bin_ = F.add_months("first", (F.floor(gap / months) * months).cast("int")).cast("timestamp")
        every = F.expr(f"interval {months} month")
    own = ["status"] if status else []
    counts = rows.groupBy(bin_.alias("bin"), *own).agg(F.count("*").alias("cases"))
    spine = first.select(F.explode(F.sequence("first", "last", every)).alias("bin"))
    if status:
        spine = spine.join(counts.select("status").distinct())
    return spine.join(counts, ["bin", *own], "left").na.fill(0, ["cases"])
