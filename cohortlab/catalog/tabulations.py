"""FREQ, TABLES, MEANS, SUMMARIZE, 2x2 and stratified analyses, rates and epidemic curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.catalog import query, rounded, table
from cohortlab.catalog.numeric import LOG_WEIGHT, SUPPORT, conditional_odds, two_sided_p
from cohortlab.operators import tabulate as t

QUERIES: dict = {}

WILSON = """
  select {keys} value, false as is_missing, count, round(p, 6) as proportion, round(cum / n, 6) as cumulative,
    round(case when count = n then 1.0 else (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) end, 6) as low,
    round(case when count = n then 1.0 else (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) end, 6) as high
  from (select *, count / n as p from (
    select *, sum(count) over ({over}) :: double as n, sum(count) over ({over} order by value rows unbounded preceding) :: double as cum
    from (select {keys} {value} as value, count(*) as count from {source} group by all)))"""


@query(QUERIES, WILSON.format(keys="", over="", value="l_returnflag", source="lineitem where l_quantity > 10"))
def freq_selected(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 10")
    return rounded(t.freq(rows, "l_returnflag"))


@query(QUERIES, WILSON.format(keys="stratum,", over="partition by stratum", value="o_orderpriority", source="(select *, o_orderstatus as stratum from orders)"))
def freq_by_stratum(spark, sf_dir):
    return rounded(t.freq(table(spark, sf_dir, "orders"), "o_orderpriority", stratum="o_orderstatus"))


@query(QUERIES, """
  with c as (select l_returnflag as exposure, l_linestatus as outcome, count(*) as count from lineitem group by all),
  g as (select * from (select distinct exposure from c), (select distinct outcome from c)),
  f as (select exposure, outcome, coalesce(count, 0) as count from g left join c using (exposure, outcome))
  select *, sum(count) over (partition by exposure) :: bigint as row_total, sum(count) over (partition by outcome) :: bigint as col_total, sum(count) over () :: bigint as total,
    round(100.0 * count / sum(count) over (partition by exposure), 6) as row_pct, round(100.0 * count / sum(count) over (partition by outcome), 6) as col_pct,
    round(sum(count) over (partition by exposure) * sum(count) over (partition by outcome) / (sum(count) over ()) :: double, 6) as expected
  from f""")
def tables_cells(spark, sf_dir):
    return rounded(t.tables(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")).drop("row", "col")


@query(QUERIES, """
  with c as (select o_orderstatus as s, o_orderpriority as e, (o_totalprice > 200000) as o, count(*) as k from orders group by all),
  f as (select *, sum(k) over (partition by s, e) :: double as r, sum(k) over (partition by s, o) :: double as q, sum(k) over (partition by s) :: double as n from c)
  select s as o_orderstatus, round(sum((k - r * q / n) ** 2 / (r * q / n)), 6) as chi2, ((count(distinct e) - 1) * (count(distinct o) - 1)) :: bigint as df, round(min(r * q / n), 6) as least_expected from f group by s""")
def tables_pearson_by_stratum(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("high", (F.col("o_totalprice") > 200000).cast("string"))
    cells = t.tables(rows, "o_orderpriority", "high", ["o_orderstatus"])
    return rounded(t.pearson(cells, ["o_orderstatus"]).drop("p"))


@query(QUERIES, """
  select l_returnflag as "EXPOSURE", l_linestatus as "OUTCOME", 'l_returnflag' as "VARNAME", sum(l_quantity) as "COUNT" from lineitem group by all""")
def tables_weighted_outtable(spark, sf_dir):
    cells = t.tables(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", weight="l_quantity")
    return t.outtable(cells, "l_returnflag")


FOURFOLD = """select {keys} count(*) filter (e and o) as a, count(*) filter (e and not o) as b, count(*) filter (not e and o) as c, count(*) filter (not e and not o) as d from ({rows}) group by all"""
LABELLED = "select l.quality = 0 as e, l.toxic = 1 as o, d.lang from labels l join documents d using (doc_id)"


@query(QUERIES, f"""
  with x as (select a :: double as a, b :: double as b, c :: double as c, d :: double as d, (a + b + c + d) :: double as n from ({FOURFOLD.format(keys='', rows=LABELLED)})),
  y as (select *, a / (a + b) as r1, c / (c + d) as r0, a * d - b * c as x, (a + b) * (c + d) * (a + c) * (b + d) as m, 1.959963984540054 as z from x)
  select a :: bigint as a, b :: bigint as b, c :: bigint as c, d :: bigint as d, round(r1, 6) as risk_exposed, round(r0, 6) as risk_unexposed, round(a * d / (b * c), 6) as odds_ratio,
    round(exp(ln(a * d / (b * c)) - z * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) as or_low, round(exp(ln(a * d / (b * c)) + z * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) as or_high,
    round(r1 / r0, 6) as risk_ratio, round(exp(ln(r1 / r0) - z * sqrt(b / (a * (a + b)) + d / (c * (c + d)))), 6) as rr_low, round(exp(ln(r1 / r0) + z * sqrt(b / (a * (a + b)) + d / (c * (c + d)))), 6) as rr_high,
    round(r1 - r0, 6) as risk_difference, round(r1 - r0 - z * sqrt(r1 * (1 - r1) / (a + b) + r0 * (1 - r0) / (c + d)), 6) as rd_low, round(r1 - r0 + z * sqrt(r1 * (1 - r1) / (a + b) + r0 * (1 - r0) / (c + d)), 6) as rd_high,
    round(n * x * x / m, 6) as chi2_pearson, round((n - 1) * x * x / m, 6) as chi2_mh, round(n * greatest(abs(x) - n / 2, 0) ** 2 / m, 6) as chi2_yates
  from y""")
def fourfold_estimates(spark, sf_dir):
    cells = _labelled_cells(spark, sf_dir)
    return rounded(t.fourfold_analysis(cells, exact=False).drop("p_pearson", "p_mh", "p_yates"))


def _labelled_cells(spark, sf_dir, strata=()):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return t.fourfold(rows, F.col("quality") == 0, F.col("toxic") == 1, list(strata))


@query(QUERIES, f"""
  with t as ({FOURFOLD.format(keys='', rows=LABELLED)}),
  k as (select *, unnest(generate_series(greatest(0, (a + b) + (a + c) - (a + b + c + d)), least(a + b, a + c))) as i from t),
  p as (select *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
    - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1)) as p from k),
  o as (select *, max(p) filter (i = a) over () as po from p)
  select a, b, c, d, round(least(1, sum(p) filter (i <= a)), 6) as fisher_left, round(least(1, sum(p) filter (i >= a)), 6) as fisher_right,
    round(least(1, sum(p) filter (p <= po * 1.000001)), 6) as fisher_two, round(sum(p) filter (i <= a) - any_value(po) / 2, 6) as mid_p_left, round(sum(p) filter (i >= a) - any_value(po) / 2, 6) as mid_p_right
  from o group by a, b, c, d""")
def fourfold_exact(spark, sf_dir):
    out = t.fourfold_analysis(_labelled_cells(spark, sf_dir))
    return rounded(out.select("a", "b", "c", "d", "fisher_left", "fisher_right", "fisher_two", "mid_p_left", "mid_p_right"))


@query(QUERIES, f"""
  with recursive t as ({FOURFOLD.format(keys='lang,', rows=LABELLED)}), {conditional_odds(f"select lang, a, i, {LOG_WEIGHT} as lw from ({SUPPORT})", 'lang')},
  x as (select lang, (a + b + c + d) :: double as n, (a * d - b * c) :: double as x, ((a + b) * (c + d) * (a + c) * (b + d)) :: double as m from t),
  y as (select lang, case when m <> 0 then n * x * x / m end as p, case when m <> 0 then (n - 1) * x * x / m end as q, case when m <> 0 then n * greatest(abs(x) - n / 2, 0) ** 2 / m end as r from x)
  select t.lang, round(estimate, 6) as conditional_or, round(exact_low, 6) as cor_exact_low, round(exact_high, 6) as cor_exact_high, round(mid_low, 6) as cor_mid_low, round(mid_high, 6) as cor_mid_high,
    round({two_sided_p('sqrt(p)')}, 6) as p_pearson, round({two_sided_p('sqrt(q)')}, 6) as p_mh, round({two_sided_p('sqrt(r)')}, 6) as p_yates
  from t join y on t.lang is not distinct from y.lang left join odds on odds.lang = t.lang where t.lang is not null""")
def fourfold_conditional_odds(spark, sf_dir):
    """Conditional odds ratio with exact and mid-P limits, p-values: bisection on noncentral distributions."""
    out = t.fourfold_analysis(_labelled_cells(spark, sf_dir, ["lang"]))
    return rounded(out.select("lang", "conditional_or", "cor_exact_low", "cor_exact_high", "cor_mid_low", "cor_mid_high", "p_pearson", "p_mh", "p_yates"))


@query(QUERIES, f"""
  with t as (select a :: double as a, b :: double as b, c :: double as c, d :: double as d, (a + b + c + d) :: double as n from ({FOURFOLD.format(keys='lang,', rows=LABELLED)})),
  s as (select count(*) as strata, sum(a * d / n) as r, sum(b * c / n) as s, sum((a + d) * a * d / n ** 2) as p, sum(((a + d) * b * c + (b + c) * a * d) / n ** 2) as q, sum((b + c) * b * c / n ** 2) as t,
    sum(a * (c + d) / n) as u, sum(c * (a + b) / n) as v, sum(((a + c) * (a + b) * (c + d) - a * c * n) / n ** 2) as w, sum((a * d - b * c) / n) as x,
    sum((a + b) * (c + d) * (a + c) * (b + d) / ((n - 1) * n * n)) as y, 1.959963984540054 as z from t),
  e as (select t.*, r / s as o, (1 - r / s) as qa, n - (a + b) - (a + c) + r / s * ((a + b) + (a + c)) as qb, -(r / s) * (a + b) * (a + c) as qc from t, s cross join (select 1)),
  f as (select *, (a + b) as n1, (a + c) as m1, -2 * qc / (qb + sqrt(qb * qb - 4 * qa * qc)) as h from (select a, b, c, d, n, qa, qb, qc from e)),
  g as (select *, 1 / (1 / h + 1 / (n1 - h) + 1 / (m1 - h) + 1 / (n - n1 - m1 + h)) as vh from f),
  k as (select sum((a - h) ** 2 / vh) as bd, sum(a - h) as gap, sum(vh) as vs, count(*) - 1 as df,
    sum(1 / (b / (a * (a + b)) + d / (c * (c + d)))) as su, sum(ln(a / (a + b) / (c / (c + d))) / (b / (a * (a + b)) + d / (c * (c + d)))) as sul, sum(ln(a / (a + b) / (c / (c + d))) ** 2 / (b / (a * (a + b)) + d / (c * (c + d)))) as sull,
    sum(1 / (1 / a + 1 / b + 1 / c + 1 / d)) as sw, sum(ln(a * d / (b * c)) / (1 / a + 1 / b + 1 / c + 1 / d)) as swl, sum(ln(a * d / (b * c)) ** 2 / (1 / a + 1 / b + 1 / c + 1 / d)) as swll from g)
  select strata, round(r / s, 6) as mh_or, round(exp(ln(r / s) - z * sqrt(p / (2 * r * r) + q / (2 * r * s) + t / (2 * s * s))), 6) as mh_or_low, round(exp(ln(r / s) + z * sqrt(p / (2 * r * r) + q / (2 * r * s) + t / (2 * s * s))), 6) as mh_or_high,
    round(u / v, 6) as mh_rr, round(exp(ln(u / v) - z * sqrt(w / (u * v))), 6) as mh_rr_low, round(exp(ln(u / v) + z * sqrt(w / (u * v))), 6) as mh_rr_high,
    round(x * x / y, 6) as mh_chi2, round(greatest(abs(x) - 0.5, 0) ** 2 / y, 6) as mh_chi2_corrected, round(bd, 6) as breslow_day, round(bd - gap * gap / vs, 6) as tarone, round(swll - swl * swl / sw, 6) as woolf, round(sull - sul * sul / su, 6) as woolf_rr, df
  from s, k""".replace("t, s cross join (select 1)", "t, s").replace("select t.*, r / s as o", "select t.a, t.b, t.c, t.d, t.n, s.r / s.s as o").replace("(1 - r / s) as qa", "(1 - s.r / s.s) as qa").replace("n - (a + b) - (a + c) + r / s * ((a + b) + (a + c)) as qb", "t.n - (t.a + t.b) - (t.a + t.c) + s.r / s.s * ((t.a + t.b) + (t.a + t.c)) as qb").replace("-(r / s) * (a + b) * (a + c) as qc", "-(s.r / s.s) * (t.a + t.b) * (t.a + t.c) as qc"))
def stratified_mantel_haenszel(spark, sf_dir):
    """Strata: thirds of the labelled documents by id, so that each has all four cells."""
    return rounded(t.stratified(_thirds(spark, sf_dir)))


def _thirds(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("lang", F.col("doc_id") % 3)
    return t.fourfold(rows, F.col("quality") == 0, F.col("toxic") == 1, ["lang"])


QUERIES["stratified_mantel_haenszel"] = (stratified_mantel_haenszel, QUERIES["stratified_mantel_haenszel"][1].replace(LABELLED, "select quality = 0 as e, toxic = 1 as o, doc_id % 3 as lang from labels"))


@query(QUERIES, f"""
  with recursive t as ({FOURFOLD.format(keys='lang,', rows="select quality = 0 as e, toxic = 1 as o, doc_id % 3 as lang from labels")}),
  w as (select lang, a, i, {LOG_WEIGHT} as lw from ({SUPPORT})), s as (select sum(a) as a from t),
  c as (select x.i + y.i + z.i as i, x.lw + y.lw + z.lw as lw from w x, w y, w z where x.lang = 0 and y.lang = 1 and z.lang = 2),
  m as (select max(lw) as top from c), g as (select i, top + ln(sum(exp(lw - top))) as lw from c, m group by i, top),
  {conditional_odds("select 1 as one, s.a, g.i, g.lw from g, s", 'one')}
  select round(estimate, 6) as estimate, round(exact_low, 6) as exact_low, round(exact_high, 6) as exact_high, round(mid_low, 6) as mid_low, round(mid_high, 6) as mid_high from odds""")
def stratified_exact(spark, sf_dir):
    """Exact common odds ratio: the strata's distributions are convolved."""
    return rounded(t.stratified_exact(_thirds(spark, sf_dir)))


@query(QUERIES, """
  with r as (select l_quantity as x, count(*) filter (l_returnflag = 'R') :: double as a, count(*) :: double as n from lineitem group by 1),
  s as (select sum(a * x) as t1, sum(n * x) as t2, sum(n * x * x) as t3, sum(a) as k, sum(n) as n from r)
  select round((t1 - k * t2 / n) ** 2 / (k * (n - k) * (n * t3 - t2 * t2) / (n * n * (n - 1))), 6) as chi2_trend from s""")
def trend_chi_square(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("cases"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("controls"))
    return rounded(t.trend(rows, "l_quantity"))


@query(QUERIES, """
  select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean, round(var_samp(o_totalprice), 2) as variance, round(stddev_samp(o_totalprice), 4) as sd,
    min(o_totalprice) as min,
    round((quantile_disc(o_totalprice, 0.25 order by o_totalprice) + quantile_disc(o_totalprice, 0.75 order by o_totalprice desc)) / 2, 4) as q25,
    round((quantile_disc(o_totalprice, 0.5 order by o_totalprice) + quantile_disc(o_totalprice, 0.5 order by o_totalprice desc)) / 2, 4) as median,
    round((quantile_disc(o_totalprice, 0.75 order by o_totalprice) + quantile_disc(o_totalprice, 0.25 order by o_totalprice desc)) / 2, 4) as q75,
    max(o_totalprice) as max from orders group by 1""")
def means_by_group(spark, sf_dir):
    out = t.means(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"])
    return out.select("o_orderstatus", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), F.round("sd", 4).alias("sd"),
                      "min", F.round("q25", 4).alias("q25"), F.round("median", 4).alias("median"), F.round("q75", 4).alias("q75"), "max")


@query(QUERIES, """select count(*) as n, round(sum(l_quantity), 4) as total, round(avg(l_quantity), 6) as mean,
  (select l_quantity from (select l_quantity, count(*) as k from lineitem group by 1 order by k desc, l_quantity limit 1)) as mode from lineitem""")
def means_mode(spark, sf_dir):
    return rounded(t.means(table(spark, sf_dir, "lineitem"), "l_quantity").select("n", "total", "mean", "mode"))


@query(QUERIES, """
  select c_mktsegment, count(*) as records, count(c_name) as named, round(avg(c_acctbal), 6) as mean, round(sum(c_acctbal), 4) as total, min(c_acctbal) as least, max(c_acctbal) as most,
    round(stddev_samp(c_acctbal), 6) as sd, round(stddev_pop(c_acctbal), 6) as sdp, round(var_samp(c_acctbal), 3) as var, round(var_pop(c_acctbal), 3) as varp,
    arg_min(c_name, c_custkey) as first, arg_max(c_name, c_custkey) as last from customer group by 1""")
def summarize_all(spark, sf_dir):
    wanted = [("records", "COUNT", None), ("named", "COUNT", "c_name"), ("mean", "AVG", "c_acctbal"), ("total", "SUM", "c_acctbal"), ("least", "MIN", "c_acctbal"), ("most", "MAX", "c_acctbal"),
              ("sd", "STDEV", "c_acctbal"), ("sdp", "STDEVP", "c_acctbal"), ("var", "VAR", "c_acctbal"), ("varp", "VARP", "c_acctbal"), ("first", "FIRST", "c_name"), ("last", "LAST", "c_name")]
    out = t.summarize(table(spark, sf_dir, "customer"), wanted, ["c_mktsegment"], ["c_custkey"])
    return rounded(out).withColumns({"total": F.round("total", 4), "var": F.round("var", 3), "varp": F.round("varp", 3)})


@query(QUERIES, """select l_returnflag, l_linestatus, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) as mean, sum(l_quantity) as mass from lineitem group by all""")
def summarize_weighted(spark, sf_dir):
    out = t.summarize(table(spark, sf_dir, "lineitem"), [("mean", "AVG", "l_discount"), ("mass", "COUNT", "l_discount")], ["l_returnflag", "l_linestatus"], weight="l_quantity")
    return rounded(out)


@query(QUERIES, """select c_mktsegment, count(*) filter (lower(n_name) = 'nation_3') as numerator, count(*) as denominator, round(count(*) filter (lower(n_name) = 'nation_3') * 100000.0 / count(*), 6) as rate
  from customer join nation on c_nationkey = n_nationkey group by 1""")
def rate_by_segment(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(t.rate(rows, "n_name", "Nation_3", by=["c_mktsegment"]))


@query(QUERIES, """
  with c as (select date_trunc('day', ts) as bin, event_type as status, count(*) as cases from events group by all),
  s as (select unnest(generate_series((select min(bin) from c), (select max(bin) from c), interval 1 day)) as bin),
  g as (select * from s, (select distinct status from c))
  select g.bin :: timestamp as bin, g.status, coalesce(cases, 0) as cases from g left join c using (bin, status)""")
def epi_curve_daily(spark, sf_dir):
    return t.epi_curve(table(spark, sf_dir, "events"), "ts", "day", status="event_type").withColumn("bin", F.col("bin").cast("timestamp_ntz"))


@query(QUERIES, """
  with c as (select date_trunc('month', o_orderdate) as t from orders), f as (select min(t) as first, max(t) as last from c),
  b as (select first + to_months(((datediff('month', first, t) // 3) * 3) :: int) as bin, count(*) as cases from c, f group by 1),
  s as (select unnest(generate_series(first, last, interval 3 month)) as bin from f)
  select s.bin :: timestamp as bin, coalesce(cases, 0) as cases from s left join b using (bin)""")
def epi_curve_quarterly(spark, sf_dir):
    return t.epi_curve(table(spark, sf_dir, "orders"), "o_orderdate", "month", 3).withColumn("bin", F.col("bin").cast("timestamp_ntz"))
