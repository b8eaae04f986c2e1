"""Complex-sample estimates. Design: strata are nations, sampling units market segments, weights the balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.catalog import query, rounded, table
from cohortlab.operators import survey as s

QUERIES: dict = {}


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("size", F.when(F.col("c_custkey") % 3 == 0, "large").when(F.col("c_custkey") % 3 == 1, "middle").otherwise("small"))


ROWS = "(select *, c_nationkey as h, c_mktsegment as u, c_acctbal as w, case c_custkey % 3 when 0 then 'large' when 1 then 'middle' else 'small' end as size from customer where c_acctbal >= 0)"
UNITS = f"(select h, count(distinct u) as m from {ROWS} group by 1)"


@query(QUERIES, f"""
  with r as {ROWS}, t as (select sum(w) as wt, count(*) as nt from r), p as (select size as value, count(*) as count, sum(w) as weighted, sum(w) / any_value(wt) as p, any_value(wt) as wt, any_value(nt) as nt from r, t group by 1),
  q as (select value, r.h, r.u, sum((case when r.size = value then w else 0 end - p * w) / wt) as q from r, p group by all),
  v as (select value, sum(s) as variance from (select value, q.h, case when any_value(m) > 1 then (any_value(m) * sum(q * q) - sum(q) ** 2) / (any_value(m) - 1) else 0 end as s from q join {UNITS} using (h) group by 1, 2) group by 1)
  select value, count, round(weighted, 2) as weighted, round(p, 6) as proportion, round(sqrt(variance), 8) as std_err, round(variance / (p * (1 - p) / (nt - 1)), 6) as design_effect, (select sum(m) - count(*) from {UNITS}) :: bigint as df from p join v using (value)""")
def survey_freq(spark, sf_dir):
    out = s.freq(_rows(spark, sf_dir), "size", "c_mktsegment", "c_nationkey", "c_acctbal")
    return out.select("value", "count", F.round("weighted", 2).alias("weighted"), F.round("proportion", 6).alias("proportion"), F.round("std_err", 8).alias("std_err"), F.round("design_effect", 6).alias("design_effect"), "df")


@query(QUERIES, f"""
  with r as (select *, n.n_regionkey as e, size as o from {ROWS} c join nation n on n.n_nationkey = c.c_nationkey),
  x as (select e, sum(w) as wr, count(*) as nr from r group by 1), y as (select o, sum(w) as wk from r group by 1),
  p as (select e, o, count(*) as count, sum(w) as wc, any_value(wr) as wr, any_value(nr) as nr, any_value(wk) as wk from r join x using (e) join y using (o) group by all),
  q as (select p.e, p.o, r.h, r.u, sum((case when r.o = p.o then w else 0 end - wc / wr * w) / wr) as q from p join r on r.e = p.e group by all),
  v as (select e, o, sum(s) as variance from (select e, o, q.h, case when any_value(m) > 1 then (any_value(m) * sum(q * q) - sum(q) ** 2) / (any_value(m) - 1) else 0 end as s from q join {UNITS} using (h) group by 1, 2, 3) group by 1, 2)
  select e :: varchar as exposure, o as outcome, count, round(wc / wr, 6) as row_share, round(wc / wk, 6) as col_share, round(sqrt(variance), 8) as std_err, round(variance / (wc / wr * (1 - wc / wr) / (nr - 1)), 6) as design_effect from p join v using (e, o)""")
def survey_tables(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = _rows(spark, sf_dir).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = s.tables(rows, "n_regionkey", "size", "c_mktsegment", "c_nationkey", "c_acctbal")
    return out.select("exposure", "outcome", "count", F.round("row_share", 6).alias("row_share"), F.round("col_share", 6).alias("col_share"), F.round("std_err", 8).alias("std_err"), F.round("design_effect", 6).alias("design_effect"))


@query(QUERIES, f"""
  with r as (select *, c_custkey :: double as x from {ROWS}), p as (select size as domain, count(*) as count, sum(w) as wt, sum(w * x) / sum(w) as mean, min(x) as min, max(x) as max from r group by 1),
  q as (select domain, h, u, sum(w * (x - mean) / wt) as q from r join p on domain = size group by all),
  v as (select domain, sum(s) as variance from (select domain, q.h, case when any_value(m) > 1 then (any_value(m) * sum(q * q) - sum(q) ** 2) / (any_value(m) - 1) else 0 end as s from q join {UNITS} using (h) group by 1, 2) group by 1)
  select domain, count, round(mean, 4) as mean, round(sqrt(variance), 4) as std_err, min, max from p join v using (domain)""")
def survey_means(spark, sf_dir):
    out = s.means(_rows(spark, sf_dir), "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal", "size")
    return out.select("domain", "count", F.round("mean", 4).alias("mean"), F.round("std_err", 4).alias("std_err"), "min", "max")


@query(QUERIES)
def survey_limits(spark, sf_dir):
    """Limits with Student's t quantile of the design's degrees of freedom."""
    return rounded(s.freq(_rows(spark, sf_dir), "size", "c_mktsegment", "c_nationkey", "c_acctbal").select("value", "lcl", "ucl"))
