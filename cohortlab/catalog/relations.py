"""RELATE, MERGE, import merges, DELETE, SORT, RECODE and key joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlab.catalog import query, rounded, table
from cohortlab.operators import relational as r
from cohortlab.operators import tabulate as t

QUERIES: dict = {}


@query(QUERIES, "select o.*, c.* from orders o join customer c on o.o_custkey = c.c_custkey")
def relate_matching(spark, sf_dir):
    return r.relate(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")])


@query(QUERIES, """
  select c_custkey, count(o_orderkey) as orders, count(*) as records from customer left join orders on c_custkey = o_custkey group by 1""")
def relate_all(spark, sf_dir):
    rows = r.relate(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], keep_all=True)
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.count("*").alias("records"))


@query(QUERIES, """
  select a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey as n_nationkey2, b.n_name as n_name2, b.n_regionkey as n_regionkey2
  from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey = b.n_nationkey""")
def relate_two_keys_renamed(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return r.relate(nation, nation, [("n_regionkey", "n_regionkey"), ("n_nationkey", "n_nationkey")])


def _deltas(spark, sf_dir):
    """Every third customer with another balance, some without one, and as many new ones."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    changed = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 6 == 0, F.col("c_acctbal") + 100))
    return changed.unionByName(c.withColumn("c_custkey", F.col("c_custkey") + 10_000_000))


DELTAS = """(select c_custkey, c_name, c_nationkey, case when c_custkey % 6 = 0 then c_acctbal + 100 end as c_acctbal, c_mktsegment from customer where c_custkey % 3 = 0
  union all select c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey % 3 = 0)"""


@query(QUERIES, f"""
  select coalesce(c.c_custkey, d.c_custkey) as c_custkey, case when d.c_custkey is not null then d.c_name else c.c_name end as c_name, case when d.c_custkey is not null then d.c_nationkey else c.c_nationkey end as c_nationkey,
    round(case when d.c_custkey is not null then d.c_acctbal else c.c_acctbal end, 6) as c_acctbal, case when d.c_custkey is not null then d.c_mktsegment else c.c_mktsegment end as c_mktsegment
  from customer c full join {DELTAS} d on c.c_custkey = d.c_custkey""")
def merge_upsert(spark, sf_dir):
    return rounded(r.merge(table(spark, sf_dir, "customer"), _deltas(spark, sf_dir), [("c_custkey", "c_custkey")], ["c_custkey"]))


@query(QUERIES, f"""
  select coalesce(c.c_custkey, d.c_custkey) as c_custkey, coalesce(d.c_name, c.c_name) as c_name, coalesce(d.c_nationkey, c.c_nationkey) as c_nationkey,
    round(coalesce(d.c_acctbal, c.c_acctbal), 6) as c_acctbal, coalesce(d.c_mktsegment, c.c_mktsegment) as c_mktsegment
  from customer c full join {DELTAS} d on c.c_custkey = d.c_custkey""")
def import_update_and_append(spark, sf_dir):
    return rounded(r.import_merge(table(spark, sf_dir, "customer"), _deltas(spark, sf_dir), "c_custkey"))


@query(QUERIES, f"""
  select c.c_custkey, c.c_name, c.c_nationkey, round(coalesce(d.c_acctbal, c.c_acctbal), 6) as c_acctbal, c.c_mktsegment from customer c left join {DELTAS} d on c.c_custkey = d.c_custkey""")
def import_update_only(spark, sf_dir):
    return rounded(r.import_merge(table(spark, sf_dir, "customer"), _deltas(spark, sf_dir), "c_custkey", "update-only"))


@query(QUERIES, f"""select * from customer union all select d.* from {DELTAS} d anti join customer c using (c_custkey)""")
def import_append_new(spark, sf_dir):
    return r.import_merge(table(spark, sf_dir, "customer"), _deltas(spark, sf_dir), "c_custkey", "append-new")


@query(QUERIES, f"""
  select count(*) filter (c.c_custkey is null) as new, count(c.c_custkey) as matching, count(*) filter (c.c_custkey is not null and d.c_acctbal is not null) as changed,
    count(*) filter (c.c_custkey is not null and d.c_acctbal is null) as unchanged, 0 :: bigint as duplicate_key, 0 :: bigint as blank_key from {DELTAS} d left join customer c using (c_custkey)""")
def import_preview_counts(spark, sf_dir):
    return r.import_preview(table(spark, sf_dir, "customer"), _deltas(spark, sf_dir), "c_custkey")


@query(QUERIES, " union all ".join(
    f"select '{c}' as field, count({c}) as present, count(distinct lower({c} :: varchar)) as distinct_values, count({c}) = count(*) and count(distinct lower({c} :: varchar)) = count(*) as is_key from customer"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def import_candidate_keys(spark, sf_dir):
    return r.candidate_keys(table(spark, sf_dir, "customer").drop("c_acctbal"))


@query(QUERIES, """
  with k as (select *, row_number() over (partition by o_orderstatus, o_orderpriority order by 1) as i from (select o_orderstatus, o_orderpriority from orders)),
  m as (select o_orderstatus, o_orderpriority, count(*) as n from orders where o_totalprice > 300000 group by all)
  select o_orderstatus, o_orderpriority, count(*) as kept from k left join m using (o_orderstatus, o_orderpriority) where i > coalesce(n, 0) group by all""")
def delete_bag(spark, sf_dir):
    """Records are status and priority only, so that copies abound; as many go as cost over 300000."""
    orders = table(spark, sf_dir, "orders")
    fields = ["o_orderstatus", "o_orderpriority"]
    kept, _ = r.delete(orders.select(fields), orders.where("o_totalprice > 300000").select(fields), fields)
    return kept.groupBy(*fields).agg(F.count("*").alias("kept"))


@query(QUERIES, "select * from orders where not o_totalprice > 300000 union all select * from orders where o_totalprice > 300000")
def undelete_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kept, gone = r.delete(orders, orders.where("o_totalprice > 300000"), ["o_orderkey"])
    return r.undelete(kept, gone, "o_orderkey")


@query(QUERIES, """
  select p_partkey, row_number() over (order by lower(p_brand) nulls first, p_size desc nulls last, p_partkey) as place from part""")
def sort_stable(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ordered = r.sort(part, [("p_brand", False), ("p_size", True)], "p_partkey")
    place = F.row_number().over(Window.orderBy(F.lower("p_brand").asc_nulls_first(), F.col("p_size").desc_nulls_last(), "p_partkey"))
    return ordered.select("p_partkey", place.cast("long").alias("place"))


BAND = "case when o_totalprice <= 100000 then 'low' when o_totalprice <= 250000 then 'middle' when o_totalprice > 250000 then 'high' else 'unknown' end"


@query(QUERIES, f"select stratum, value, false as is_missing, count(*) as count from (select o_orderstatus as stratum, {BAND} as value from orders) group by all")
def recode_freq(spark, sf_dir):
    rows = r.recode(table(spark, sf_dir, "orders"), "o_totalprice", "band", [(None, 100000, "low"), (100000, 250000, "middle"), (250000, None, "high")], "unknown")
    return t.freq(rows, "band", "o_orderstatus", limits=False).drop("proportion", "cumulative")


@query(QUERIES, """
  with s as (select r_regionkey as code, upper(r_name) as name from region), d as (select n_regionkey as region, count(*) as nations from nation group by 1)
  select s.code, s.name, d.region, d.nations from s join d on s.code = d.region""")
def choropleth_join(spark, sf_dir):
    shapes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code"), F.upper("r_name").alias("name"))
    data = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"))
    return r.key_join(shapes, data, "code", "region")[0]


@query(QUERIES, """
  with s as (select n_nationkey % 20 as k from nation), b as (select k, count(*) as n from s group by 1), d as (select case when n_nationkey = 6 then 7 else n_nationkey end as k from nation),
  m as (select k, count(*) as n from d group by 1)
  select class, count(*) as records from (
    select case when b.k is null then 'data-unmatched' when b.n > 1 then 'data-ambiguous' when m.n > 1 then 'data-matched-many' else 'data-matched' end as class from d left join b using (k) join m using (k)
    union all select case when b.n > 1 then 'boundary-duplicate' when m.k is null then 'boundary-unmatched' else 'boundary-matched' end from s join b using (k) left join m using (k)) group by 1""")
def choropleth_diagnostics(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    shapes = nation.select((F.col("n_nationkey") % 20).alias("k"))
    return r.key_join(shapes, nation.select(F.when(F.col("n_nationkey") == 6, 7).otherwise(F.col("n_nationkey")).alias("k2")), "k", "k2")[1]
