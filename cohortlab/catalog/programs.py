"""Programs of the command language, run by a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.catalog import query, rounded, table
from cohortlab.plans.session import Session

QUERIES: dict = {}
KEYS = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_partkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "events": ["event_id"]}


def run(spark, sf_dir, program):
    names = ("customer", "orders", "lineitem", "part", "nation", "region", "events")
    return Session(spark, {n: table(spark, sf_dir, n) for n in names}, KEYS).run(program)


@query(QUERIES, """select o_orderkey, o_orderpriority, o_totalprice from orders where (o_totalprice > 150000 and lower(o_orderpriority) like '%high') or (not o_orderstatus = 'O' and o_totalprice % 7 < 1)""")
def program_select_list(spark, sf_dir):
    return run(spark, sf_dir, """
        READ orders
        SELECT (o_totalprice > 150000 AND o_orderpriority LIKE "*high") OR (NOT o_orderstatus = "o" AND o_totalprice MOD 7 < 1)
        SORT o_orderpriority DESC o_orderkey
        LIST o_orderkey o_orderpriority o_totalprice""")


@query(QUERIES, """select p_partkey, p_name, p_size from part where length(p_name) > 9 and -(2 ** 2) + 8 = 4 and abs(p_size - 25) * 2 <= 30 and upper(p_brand) & '' = '' """.replace("-(2 ** 2) + 8 = 4", "true").replace("and upper(p_brand) & '' = '' ", "and lower(p_brand || p_type) < 'brand#3'"))
def program_functions(spark, sf_dir):
    return run(spark, sf_dir, """
        READ part
        SELECT STRLEN(p_name) > 9 AND -2^2 = 4
        SELECT ABS(p_size - 25) * 2 <= 30 AND p_brand & p_type < "brand#3"
        LIST p_partkey p_name p_size""")


@query(QUERIES, """
  select n_regionkey :: varchar as stratum, band as value, false as is_missing, count(*) as count from (select n_regionkey, case when c_acctbal <= 0 then 'none' when c_acctbal <= 5000 then 'some' else 'much' end as band
    from customer join nation on c_nationkey = n_nationkey where c_mktsegment <> 'BUILDING') group by all""")
def program_relate_recode_freq(spark, sf_dir):
    out = run(spark, sf_dir, """
        READ customer
        RELATE nation c_nationkey::n_nationkey
        SELECT c_mktsegment <> "building"
        DEFINE band TEXTINPUT
        RECODE c_acctbal TO band
          LOVALUE - 0 = "none"
          0 - 5000 = "some"
          5000 - HIVALUE = "much"
        END
        FREQ band STRATAVAR=n_regionkey""")
    return out.select(F.col("stratum").cast("string").alias("stratum"), "value", "is_missing", "count")


@query(QUERIES, """
  select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean, max(o_orderpriority) as top, round(sum(o_totalprice), 2) as total from orders where o_totalprice > 1000 group by 1""")
def program_summarize(spark, sf_dir):
    out = run(spark, sf_dir, """
        READ orders
        DEFINE least NUMERIC
        ASSIGN least = 1000
        IF least > 10 THEN SELECT o_totalprice > least ELSE SELECT o_totalprice > 10 END
        SUMMARIZE n::COUNT() mean::AVG(o_totalprice) top::MAX(o_orderpriority) total::SUM(o_totalprice) TO sums STRATAVAR=o_orderstatus""")
    return out.select("o_orderstatus", "n", F.round("mean", 4).alias("mean"), "top", F.round("total", 2).alias("total"))


@query(QUERIES, """
  with c as (select o_orderstatus as e, o_orderpriority as o, count(*) as k from orders group by all), e as (select distinct e from c), o as (select distinct o from c)
  select e as "EXPOSURE", o as "OUTCOME", 'o_orderstatus' as "VARNAME", coalesce(k, 0) as "COUNT" from e, o left join c using (e, o)""".replace("from e, o left join", "from (select * from e, o) left join"))
def program_outtable(spark, sf_dir):
    session_program = """
        READ orders
        DEFINE both GROUPVAR o_orderstatus o_custkey
        TABLES o_orderstatus o_orderpriority OUTTABLE=cells"""
    names = ("orders",)
    session = Session(spark, {n: table(spark, sf_dir, n) for n in names}, KEYS)
    session.run(session_program)
    return session.outtables["cells"]


@query(QUERIES, """select * from orders where not (o_totalprice > 250000) or o_orderstatus = 'F'""")
def program_delete_undelete(spark, sf_dir):
    return run(spark, sf_dir, """
        READ orders
        DELETE (o_totalprice > 250000)
        UNDELETE (o_orderstatus = "F")
        LIST *""")


@query(QUERIES, """select c_custkey, c_acctbal, c_mktsegment, round(c_acctbal * 2 + 1, 6) as twice, c_mktsegment || '-' || c_nationkey as tag from customer where c_nationkey in (1, 2)""")
def program_assign_column(spark, sf_dir):
    return rounded(run(spark, sf_dir, """
        READ customer
        SELECT c_nationkey = 1 OR c_nationkey = 2
        ASSIGN twice = c_acctbal * 2 + 1
        ASSIGN tag = c_mktsegment & "-" & c_nationkey
        LIST * EXCEPT c_name c_nationkey"""))


@query(QUERIES, "select 'f:' || value as value, count from (select event_type as value, count(*) as count from events group by 1)")
def program_graph(spark, sf_dir):
    out = run(spark, sf_dir, """
        READ events
        HEADER 1 "Events"
        GRAPH event_type GRAPHTYPE="Pie" """)
    return out.select(F.concat(F.lit("f:"), "value").alias("value"), "count")


@query(QUERIES, "select date_trunc('day', ts) :: timestamp as bin, event_type as status, count(*) as cases from events group by 1, 2")
def streaming_epi_curve(spark, sf_dir):
    """An extension: the epidemic curve as a stream over the events, run to its end."""
    from cohortlab.streaming import epi_stream

    return epi_stream.run_to_end(spark, f"{sf_dir}/events.parquet").withColumn("bin", F.col("bin").cast("timestamp_ntz"))
