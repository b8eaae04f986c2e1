"""Quality, validation, scalar functions, matched studies and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.catalog import query, rounded, table
from cohortlab.catalog.numeric import two_sided_p
from cohortlab.functions import scalars as f
from cohortlab.operators import features, linkage, matched, quality

QUERIES: dict = {}


@query(QUERIES, " union all ".join(
    f"select '{c}' as field, count(nullif(trim({c} :: varchar), '')) as present, count(*) - count(nullif(trim({c} :: varchar), '')) as missing, count(nullif(trim({c} :: varchar), '')) / count(*) as completeness, {v} as violations from documents"
    for c, v in (("doc_id", "0 :: bigint"), ("text", "0 :: bigint"), ("lang", "count(*) filter (lang not in ('en', 'de'))"), ("source", "0 :: bigint"), ("n_chars", "count(*) filter (n_chars < 100 or n_chars > 5000)"))))
def quality_profile(spark, sf_dir):
    rules = {"lang": [{"type": "legal-values", "values": ["en", "de"]}], "n_chars": [{"type": "range", "min": 100, "max": 5000}]}
    return quality.profile(table(spark, sf_dir, "documents"), rules)


@query(QUERIES, """
  select c_custkey, 'c_acctbal' as field, 'range' as rule, 'warning' as severity from customer where c_acctbal < 0
  union all select c_custkey, 'c_name', 'pattern', 'error' from customer where not regexp_full_match(c_name, 'Customer#\\d*[0-4]')
  union all select c_custkey, 'c_nationkey', 'unique', 'error' from (select *, count(*) over (partition by c_nationkey) as n from customer) where n > 1""")
def validation_issues(spark, sf_dir):
    rules = {"c_acctbal": [{"type": "range", "min": 0, "severity": "warning"}], "c_name": [{"type": "pattern", "pattern": r"Customer#\d*[0-4]"}, {"type": "required"}], "c_nationkey": [{"type": "unique"}]}
    return quality.issues(table(spark, sf_dir, "customer"), "c_custkey", rules)


@query(QUERIES, "select o_custkey, o_orderstatus, count(*) as records from orders group by all having count(*) > 1")
def quality_duplicates(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query(QUERIES, """
  select p_partkey, abs(p_size - 25) as abs, round(cos(p_size), 6) as cos, round(sin(p_size), 6) as sin, round(tan(p_size), 6) as tan, round(exp(p_size / 10), 6) as exp, round(sqrt(p_size), 6) as sqrt, round(ln(p_retailprice), 6) as ln,
    round(log10(p_retailprice), 6) as log, trunc(p_retailprice) :: double as trunc, floor(p_retailprice * 10 + 0.5) / 10 as round, case when p_size < 20 then 0.0 else 1.0 end :: double as step,
    strpos(lower(p_name), 'ring') :: int as find, length(p_name) :: int as strlen, upper(p_name) as upper, substring(p_name, 2, 3) as substring, p_size :: double as number from part""")
def scalar_numbers_and_texts(spark, sf_dir):
    g = f.FUNCTIONS
    size, price, name = F.col("p_size"), F.col("p_retailprice"), F.col("p_name")
    return rounded(table(spark, sf_dir, "part").select(
        "p_partkey", g["ABS"](size - 25).alias("abs"), g["COS"](size).alias("cos"), g["SIN"](size).alias("sin"), g["TAN"](size).alias("tan"), g["EXP"](size / 10).alias("exp"), g["SQRT"](size).alias("sqrt"),
        g["LN"](price).alias("ln"), g["LOG"](price).alias("log"), g["TRUNC"](price).alias("trunc"), g["ROUND"](price, 1).alias("round"), g["STEP"](size, F.lit(20)).alias("step"),
        g["FINDTEXT"](F.lit("RING"), name).alias("find"), g["STRLEN"](name).alias("strlen"), g["UPPERCASE"](name).alias("upper"), g["SUBSTRING"](name, F.lit(2), F.lit(3)).alias("substring"), g["TXTTONUM"](size.cast("string")).alias("number")))


@query(QUERIES, """
  with d as (select o_orderkey, o_orderdate :: date as a, date '2000-02-29' as b, o_orderdate :: date + 3 - ((dayofweek(o_orderdate)) :: int) as mid from orders)
  select o_orderkey, year(a) :: int as year, month(a) :: int as month, day(a) :: int as day, datediff('day', a, b) as days,
    (case when a <= b then datesub('month', a, b) when day(b) > day(a) then (year(b) - year(a)) * 12 + month(b) - month(a) + 1 else (year(b) - year(a)) * 12 + month(b) - month(a) end) :: int as months,
    ((dayofyear(mid) - 1) // 7 + 1) :: int as epiweek, make_date(year(a), month(a), 1) :: varchar as first, datediff('day', a, b) * 1440.0 :: double as minutes from d""".replace("datesub('month', a, b)", "((year(b) - year(a)) * 12 + month(b) - month(a) - case when day(b) < day(a) and (year(b) - year(a)) * 12 + month(b) - month(a) > 0 then 1 else 0 end)"))
def scalar_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.lit("2000-02-29").cast("date").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("o_orderkey", F.year(a).alias("year"), F.month(a).alias("month"), F.dayofmonth(a).alias("day"), f.days(a, b).alias("days"), f.months(a, b).cast("int").alias("months"),
                       f.epi_week(a).alias("epiweek"), f.make_date(F.year(a), F.month(a), F.lit(1)).cast("string").alias("first"), f.minutes(a, b).alias("minutes"))


@query(QUERIES, "select c_custkey, count(*) over () as records, count(*) over (partition by c_nationkey, c_mktsegment) = 1 as unique_pair from customer")
def scalar_record_context(spark, sf_dir):
    rows = features.with_row_context(table(spark, sf_dir, "customer"), {"unique_pair": ["c_nationkey", "c_mktsegment"]}, "records")
    return rows.select("c_custkey", "records", "unique_pair")


def _pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.floor(F.col("o_orderkey") / 2).alias("set"), (F.col("o_totalprice") > 200000).alias("exposed"), (F.col("o_orderstatus") == "F").alias("case"),
        (F.col("o_totalprice") / 100000).alias("price"), F.month("o_orderdate").cast("double").alias("month"))


SETS = """(select o_orderkey // 2 as set, count(*) as n, count(*) filter (o_orderstatus = 'F') as k, bool_or(o_totalprice > 200000) filter (o_orderstatus = 'F') as ce, bool_or(o_totalprice > 200000) filter (o_orderstatus <> 'F') as co from orders group by 1)"""
CLASS = "case when n <> 2 then 'size' when k <> 1 then 'not-one-case' when ce and co then 'both' when ce then 'case-only' when co then 'control-only' else 'neither' end"


@query(QUERIES, f"select {CLASS} as class, count(*) as sets from {SETS} group by 1")
def match_pairs(spark, sf_dir):
    return matched.pairs(_pairs(spark, sf_dir), "exposed", "case", "set")


@query(QUERIES, f"""
  with t as (select count(*) filter (c = 'case-only') as b, count(*) filter (c = 'control-only') as c from (select {CLASS} as c from {SETS}))
  select b, c, round(b / c, 6) as odds_ratio, round((b - c) ** 2 / (b + c), 6) as chi2, round(greatest(0, abs(b - c) - 1) ** 2 / (b + c), 6) as chi2_corrected from t""")
def match_mcnemar(spark, sf_dir):
    return rounded(matched.mcnemar(matched.pairs(_pairs(spark, sf_dir), "exposed", "case", "set")).select("b", "c", "odds_ratio", "chi2", "chi2_corrected"))


@query(QUERIES, f"""
  with recursive t as (select count(*) filter (c = 'case-only') as b, count(*) filter (c = 'control-only') as c from (select {CLASS} as c from {SETS})),
  k as (select b, c, b + c as n, unnest(range(0, b + c + 1)) as k from t), l as (select *, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) as lw from k),
  s as (select any_value(b) as b, any_value(c) as c, any_value(n) as n, list(k order by k) as k, list(lw order by k) as lw from l),
  r as (select unnest(['low', 'high']) as side, 0 as step, 0.0 :: double as lo, 1.0 :: double as hi union all
    select side, step + 1, case when f < 0 then mid else lo end, case when f < 0 then hi else mid end from (
      select r.*, (lo + hi) / 2 as mid, case when side = 'low'
        then list_sum(list_transform(range(b + 1, n + 2), lambda j: exp(lw[j] + k[j] * ln((lo + hi) / 2) + (n - k[j]) * ln(1 - (lo + hi) / 2)))) - 0.025
        else 0.025 - list_sum(list_transform(range(1, b + 2), lambda j: exp(lw[j] + k[j] * ln((lo + hi) / 2) + (n - k[j]) * ln(1 - (lo + hi) / 2)))) end as f from r, s where step < 60)),
  e as (select list_sum(list_transform(range(1, least(b, c) + 2), lambda j: exp(lw[j] - n * ln(2)))) as tail, exp(lw[least(b, c) + 1] - n * ln(2)) as last from s)
  select b, c, round(b / c, 6) as odds_ratio, round((select lo / (1 - lo) from r where step = 60 and side = 'low'), 6) as low, round((select lo / (1 - lo) from r where step = 60 and side = 'high'), 6) as high,
    round((b - c) ** 2 / (b + c), 6) as chi2, round(greatest(0, abs(b - c) - 1) ** 2 / (b + c), 6) as chi2_corrected, round(least(1, 2 * tail), 6) as exact_two, round(least(1, 2 * tail - last), 6) as mid_p_two from t, e""")
def match_exact(spark, sf_dir):
    """Exact limits and p-values of the discordant pairs."""
    return rounded(matched.mcnemar(matched.pairs(_pairs(spark, sf_dir), "exposed", "case", "set")))


@query(QUERIES, f"""
  with recursive o as (select o_orderkey // 2 as set, o_orderstatus = 'F' as y, o_totalprice / 100000 as x0, month(o_orderdate) :: double as x1 from orders),
  d as (select max(x0) filter (y) - max(x0) filter (not y) as d0, max(x1) filter (y) - max(x1) filter (not y) as d1 from o group by set having count(*) = 2 and count(*) filter (y) = 1),
  r as (select 0 as step, 0.0 :: double as b0, 0.0 :: double as b1 union all
    select step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) from (
      select step, b0, b1, sum((1 - p) * d0) as g0, sum((1 - p) * d1) as g1, sum(p * (1 - p) * d0 * d0) as h00, sum(p * (1 - p) * d0 * d1) as h01, sum(p * (1 - p) * d1 * d1) as h11
      from (select step, b0, b1, d0, d1, 1 / (1 + exp(-b0 * d0 - b1 * d1)) as p from r, d where step < 15) group by step, b0, b1)),
  f as (select b0, b1, sum(p * (1 - p) * d0 * d0) as h00, sum(p * (1 - p) * d0 * d1) as h01, sum(p * (1 - p) * d1 * d1) as h11, 2 * (sum(ln(p)) + count(*) * ln(2)) as lr
    from (select b0, b1, d0, d1, 1 / (1 + exp(-b0 * d0 - b1 * d1)) as p from r, d where step = 15) group by b0, b1),
  e as (select 'price' as term, b0 as b, sqrt(h11 / (h00 * h11 - h01 * h01)) as s, lr from f union all select 'month', b1, sqrt(h00 / (h00 * h11 - h01 * h01)), lr from f)
  select term, round(b, 5) as coefficient, round(s, 5) as std_err, round(exp(b), 5) as odds_ratio, round(exp(b - 1.959963984540054 * s), 5) as low, round(exp(b + 1.959963984540054 * s), 5) as high,
    round(b / s, 5) as z, round({two_sided_p('abs(b / s)')}, 5) as p, round(lr, 5) as lr_chi2 from e""")
def logistic_conditional(spark, sf_dir):
    """Newton's method; one aggregation over the sets a step."""
    return rounded(matched.conditional_logistic(_pairs(spark, sf_dir), "case", ["price", "month"], "set"), 5)


def _people(spark, sf_dir):
    """Customers, and a copy of most of them with other ids, some names mistyped, some fields empty."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_nationkey", "c_mktsegment")
    typo = F.when(F.col("id") % 4 == 0, F.concat(F.substring("c_name", 1, 12), F.lit("x"), F.substring("c_name", 13, 20))).otherwise(F.col("c_name"))
    b = a.where("id % 5 <> 0").withColumn("c_name", typo).withColumn("c_mktsegment", F.when(F.col("id") % 7 != 0, F.col("c_mktsegment")))
    return a, b


B = "(select c_custkey as id, case when c_custkey % 4 = 0 then substring(c_name, 1, 12) || 'x' || substring(c_name, 13, 20) else c_name end as c_name, c_nationkey, case when c_custkey % 7 <> 0 then c_mktsegment end as c_mktsegment from customer where c_custkey % 5 <> 0)"
SCORED = f"""(select a.c_custkey as a_id, b.id as b_id, (coalesce(a.c_mktsegment = b.c_mktsegment, false)) :: int + (jaro_winkler_similarity(lower(a.c_name), lower(b.c_name)) >= 0.97) :: int as score
  from customer a join {B} b on a.c_nationkey = b.c_nationkey)"""
DECIDED = f"(select *, case when score >= 2 then 'match' when score >= 1 then 'review' else 'non-match' end as decision from {SCORED})"


def _scored(spark, sf_dir):
    a, b = _people(spark, sf_dir)
    pairs = linkage.candidates(a, b, [("c_nationkey", "c_nationkey")], "id", "id")
    return linkage.score(pairs, [("c_mktsegment", "c_mktsegment")], [("c_name", "c_name", 0.97)], 2, 1, "id", "id")


def _scores(spark, sf_dir):
    a, b = _people(spark, sf_dir)
    return linkage.Scores(a, b, [("c_nationkey", "c_nationkey")], [("c_mktsegment", "c_mktsegment")], [("c_name", "c_name", 0.97)], 2, 1, "id", "id")


@query(QUERIES, f"select decision, score, count(*) as pairs from {DECIDED} group by all")
def linkage_scores(spark, sf_dir):
    return _scores(spark, sf_dir).counts()


@query(QUERIES, f"""
  with t as (select count(*) filter (decision = 'match' and a_id = b_id) as tp, count(*) filter (decision = 'match' and a_id <> b_id) as fp, count(*) filter (decision <> 'match' and a_id = b_id) as fn from {DECIDED})
  select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) as f1 from t""")
def linkage_evaluation(spark, sf_dir):
    """Of the matches, and of true pairs that are none; other pairs do not count."""
    true = _scored(spark, sf_dir).where("decision <> 'match' and a_id = b_id").select("a_id", "b_id", "score", "decision")
    return rounded(linkage.evaluate(_scores(spark, sf_dir).pairs(2).unionByName(true), F.col("a_id") == F.col("b_id")))


@query(QUERIES)
def linkage_clusters(spark, sf_dir):
    """Greedy one-to-one clusters of the matches, in rounds of mutually best pairs."""
    return linkage.one_to_one(_scores(spark, sf_dir).pairs(2), "id", "id")


@query(QUERIES, f"""
  with l as (select a_id, b_id from {DECIDED} where decision = 'match' and a_id = b_id)
  select concat_ws('+', case when a.c_custkey is not null then 'a' || a.c_custkey end, case when b.id is not null then 'b' || b.id end) as person, coalesce(a.c_name, b.c_name) as c_name,
    case when a.c_name is not null and b.c_name is not null and lower(a.c_name) <> lower(b.c_name) then 'disagreement' when a.c_name is not null then 'a' when b.c_name is not null then 'b' else 'none' end as c_name_from
  from customer a left join l on a.c_custkey = l.a_id full join {B} b on l.b_id = b.id""")
def linkage_persons(spark, sf_dir):
    a, b = _people(spark, sf_dir)
    links = _scored(spark, sf_dir).where("decision = 'match' and a_id = b_id")
    return linkage.persons(a, b, links, "id", "id", [("c_name", "c_name")])
