"""Spatial operators over places made from the tables' ids (they have no coordinates of their own)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.catalog import query, rounded, table
from cohortlab.operators import spatial as s

QUERIES: dict = {}
LAT, LON = "(c_custkey * 7919 % 1000) / 100.0 + 40", "(c_custkey * 104729 % 1000) / 100.0 + 5"
POINTS = f"(select c_custkey as id, ({LAT}) :: double as lat, ({LON}) :: double as lon, c_acctbal as value from customer)"
KM = "2 * 6371.0088 * asin(least(1, sqrt(sin(radians({b}.lat - {a}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2)))"
NEAR = f"(select a.id as a, b.id as b, {KM.format(a='a', b='b')} as km from {POINTS} a, {POINTS} b where abs(a.lat - b.lat) < 1 and {KM.format(a='a', b='b')} <= 30)"


def _points(spark, sf_dir):
    number = lambda k: ((F.col("c_custkey") * k) % 1000).cast("double") / 100.0
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (number(7919) + 40).alias("lat"), (number(104729) + 5).alias("lon"), F.col("c_acctbal").alias("value"))


@query(QUERIES, f"select a, b, round(km, 6) as km from {NEAR}")
def distance_pairs(spark, sf_dir):
    return s.distance_pairs(_points(spark, sf_dir), 30, 6)


@query(QUERIES, f"""select a, b, 1.0 / count(*) over (partition by a) as weight from (select *, row_number() over (partition by a order by round(km, 9), b) as k from {NEAR} where a <> b) where k <= 3""")
def weights_nearest(spark, sf_dir):
    """Of those within 30 km, as the SQL has it."""
    return s.k_nearest(_points(spark, sf_dir), 3, within=30)


@query(QUERIES, f"""select a, b, 1.0 / count(*) over (partition by a) as weight from (select a.id as a, b.id as b, row_number() over (partition by a.id order by round({KM.format(a='a', b='b')}, 9), b.id) as k from {POINTS} a, {POINTS} b where a.id <> b.id) where k <= 3""")
def weights_nearest_all(spark, sf_dir):
    """However far they are."""
    return s.k_nearest(_points(spark, sf_dir), 3)


WEIGHTS = f"(select a, b, 1.0 / count(*) over (partition by a) as w from {NEAR} where a <> b)"
Z = f"(select id, value - avg(value) over () as z, count(*) over () as n from {POINTS})"


@query(QUERIES, f"""
  with t as (select sum(w * x.z * y.z) as c, sum(w) as s0 from {WEIGHTS} join {Z} x on x.id = a join {Z} y on y.id = b), q as (select sum(z * z) as ss, count(*) as n from {Z})
  select round(n / s0 * c / ss, 6) as moran_i, round(-1.0 / (n - 1), 6) as expected, n from t, q""")
def moran_global(spark, sf_dir):
    p = _points(spark, sf_dir)
    return rounded(s.moran(p.select("id", "value"), s.Band(p, 30)))


@query(QUERIES, f"""
  with l as (select a, sum(w * z) as lag from {WEIGHTS} join {Z} on id = b group by 1), m as (select avg(z * z) as m2 from {Z})
  select id, round(z * lag / m2, 5) as local_i, case when lag is null then 'isolated' else case when z >= 0 then 'high' else 'low' end || '-' || case when lag >= 0 then 'high' else 'low' end end as quadrant from {Z} left join l on id = a, m""")
def moran_local(spark, sf_dir):
    p = _points(spark, sf_dir)
    return rounded(s.local_moran(p.select("id", "value"), s.Band(p, 30)), 5)


@query(QUERIES)
def moran_pseudo_p(spark, sf_dir):
    """Permutations by hash order; rows only."""
    p = _points(spark, sf_dir)
    return s.moran_permutations(p.select("id", "value"), s.Band(p, 30), 99)


@query(QUERIES, f"""
  with w as (select a, b, w from {WEIGHTS} union all select distinct a, a, 1.0 from {WEIGHTS}), o as (select avg(value) as mean, stddev_pop(value) as sd, count(*) as n from {POINTS}),
  g as (select a as id, sum(w * value) as sv, sum(w) :: double as k, sum(w * w) :: double as kk from w join {POINTS} p on p.id = b group by 1)
  select p.id, round((sv - mean * k) / (sd * sqrt((n * kk - k * k) / (n - 1))), 5) as gi_star, g.id is null as isolated from {POINTS} p left join g on g.id = p.id, o""")
def getis_ord_star(spark, sf_dir):
    p = _points(spark, sf_dir)
    return rounded(s.getis_ord(p.select("id", "value"), s.Band(p, 30)), 5)


@query(QUERIES)
def getis_ord_simulated(spark, sf_dir):
    """99 permutations by hash order; held against plain Python by a test."""
    p = _points(spark, sf_dir)
    return s.getis_ord_permutations(p.select("id", "value"), s.Band(p, 30), 99)


@query(QUERIES)
def moran_local_simulated(spark, sf_dir):
    """99 conditional permutations by hash order; held against plain Python by a test."""
    p = _points(spark, sf_dir)
    return s.local_moran_permutations(p.select("id", "value"), s.Band(p, 30), 99)


@query(QUERIES, f"""
  with recursive n as (select a, b from {NEAR} where km <= 18), core as (select a from n group by 1 having count(*) >= 5), e as (select n.a, n.b from n semi join core c using (a) where n.b in (select a from core)),
  r as (select a, a as root from core union select e.b, r.root from r join e on e.a = r.a), l as (select a, min(root) as cluster from r group by 1)
  select distinct n.a as id, l.cluster, n.a in (select a from core) as core from n join l on l.a = n.b""")
def dbscan_clusters(spark, sf_dir):
    return s.dbscan(_points(spark, sf_dir), 18, 5)


@query(QUERIES, f"select floor(lat / 0.5) :: bigint || ':' || floor(lon / 0.5) :: bigint as cell, count(*) as count, round(sum(value), 2) as sum, round(avg(value), 5) as mean from {POINTS} group by 1")
def cell_counts(spark, sf_dir):
    p = _points(spark, sf_dir)
    return rounded(s.cell_aggregate(p, s.grid_cell(F.col("lat"), F.col("lon"), 0.5), "value"), 5).withColumn("sum", F.round("sum", 2))


@query(QUERIES, f"""
  with z as (select n_nationkey as zone, 40 + n_nationkey // 5 * 2 as south, 5 + n_nationkey % 5 * 2 as west from nation)
  select zone, count(*) as count, round(sum(value), 2) as sum, round(avg(value), 9) as mean, min(value) as min, max(value) as max from {POINTS} p join z
    on p.lat >= south and p.lat < south + 2 and p.lon >= west and p.lon < west + 2 and not (p.lat > south + 0.505 and p.lat < south + 1.005 and p.lon > west + 0.505 and p.lon < west + 1.005) group by 1""")
def zonal_statistics(spark, sf_dir):
    """Square zones with a square hole, one for each nation; a zone has its left and lower edges."""
    nation = table(spark, sf_dir, "nation")
    west, south = 5 + F.col("n_nationkey") % 5 * 2, 40 + F.floor(F.col("n_nationkey") / 5) * 2
    ring = lambda x, y, d: F.array(*[F.array((x + i).cast("double"), (y + j).cast("double")) for i, j in ((0, 0), (d, 0), (d, d), (0, d))])
    zones = nation.select(F.col("n_nationkey").alias("zone"), F.array(ring(west, south, 2), ring(west + 0.505, south + 0.505, 0.5)).alias("rings"))
    cells = _points(spark, sf_dir).select(F.col("lon").alias("x"), F.col("lat").alias("y"), "value")
    return s.zonal(cells, zones).withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 9)})


@query(QUERIES, f"select floor(lat * 1 + 0.5) as lat, floor(lon * 1 + 0.5) as lon, count(*) as cases from {POINTS} group by 1, 2 having count(*) >= 10")
def privacy_release(spark, sf_dir):
    return s.release(_points(spark, sf_dir), 10, 0)


@query(QUERIES, """
  with o as (select c_acctbal as v, row_number() over (order by c_acctbal) as i, count(*) over () as n from customer), k as (select unnest(generate_series(0, 4)) as class)
  select class, max(v) as upper from k join o on i = (n * (class + 1) + 4) // 5 group by 1""")
def classes_quantile(spark, sf_dir):
    return s.class_breaks(_points(spark, sf_dir), 5)


@query(QUERIES, "select class, round(low + (high - low) * (class + 1) / 4, 6) as upper from (select unnest(generate_series(0, 3)) as class), (select min(c_acctbal) as low, max(c_acctbal) as high from customer)")
def classes_equal(spark, sf_dir):
    return rounded(s.class_breaks(_points(spark, sf_dir), 4, "equal"))


@query(QUERIES, """
  select c_custkey, case when lat >= 56 and lat < 64 and lon >= 3 and lon < 12 then 32 when lat >= 72 and lat < 84 and lon >= 0 and lon < 42 then case when lon < 9 then 31 when lon < 21 then 33 when lon < 33 then 35 else 37 end
    else least(60, floor((lon + 180) / 6) + 1) end :: int as zone from (select c_custkey, c_custkey % 160 - 80 as lat, c_custkey * 7 % 360 - 180 as lon from customer)""")
def utm_zones(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", s.utm_zone(F.col("c_custkey") % 160 - 80, F.col("c_custkey") * 7 % 360 - 180).alias("zone"))


@query(QUERIES, f"""
  with g as (select r, c, 40 + (r + 0.5) * 1.0 as lat, 5 + (c + 0.5) * 1.0 as lon from (select unnest(generate_series(0, 9)) as r), (select unnest(generate_series(0, 9)) as c)),
  p as (select * from {POINTS}), m as (select g.r, g.c, {KM.format(a='g', b='p')} as km from g, p)
  select r :: int as row, c :: int as column, round(sum(case when km <= 200 then exp(-km * km / (2 * 40.0 * 40.0)) else 0 end) / (2 * pi() * 40.0 * 40.0), 6) as density from m group by 1, 2""")
def density_surface(spark, sf_dir):
    return rounded(s.kde(_points(spark, sf_dir), 40.0, 10, 10, (5, 40, 15, 50)))


@query(QUERIES, "select c_custkey as id, floor(c_acctbal / 1000 + 0.5) :: bigint as dots from customer")
def dot_values(spark, sf_dir):
    return s.dots(_points(spark, sf_dir), 1000)


@query(QUERIES)
def space_time_clusters(spark, sf_dir):
    """Cases: all errors, placed by their user, in bins of three days."""
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    cases = events.select(F.col("event_id").alias("id"), (F.col("user_id") % 7 + 40).cast("double").alias("lat"), (F.col("user_id") % 5 + 5).cast("double").alias("lon"), F.floor(F.datediff("ts", F.lit("2024-01-01")) / 3).alias("bin"))
    return rounded(s.space_time_scan(cases, 200, 0.5, 3))
