"""Spatial operators against brute force."""

import math
import os
from collections import Counter

import pytest

from cohortlab import queries as engine
from cohortlab.operators import features, spatial

#: The smallest tables have 15 users only.
DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def km(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


@needs_data
def test_space_time_all_errors(spark):
    """The query's best windows, over every error there is."""
    rows = [r for r in spark.read.parquet(f"{DATA}/events.parquet").where("event_type = 'error'").collect()]
    cases = [((r.user_id % 7 + 40, r.user_id % 5 + 5), (r.ts.timetuple().tm_yday - 1) // 3) for r in rows]
    n, places, bins = len(cases), sorted({c for c, _ in cases}), sorted({t for _, t in cases})
    counts = Counter(cases)
    found = {}
    for centre in places:
        for radius in sorted({km(centre, p) for p in places}):
            members = {p for p in places if km(centre, p) <= min(radius, 200) + 1e-9}
            inside = sum(k for (c, _), k in counts.items() if c in members)
            if radius > 200 or inside > 0.5 * n:
                continue
            for first in bins:
                for last in (t for t in bins if first <= t < first + 3):
                    o = sum(k for (c, t), k in counts.items() if c in members and first <= t <= last)
                    e = inside * sum(k for (_, t), k in counts.items() if first <= t <= last) / n
                    llr = o * math.log(o / e) + ((n - o) * math.log((n - o) / (n - e)) if o < n else 0) if o > e else 0.0
                    found[*centre, round(radius, 6), first, last] = (o, e, llr)
    out = engine.queries()["space_time_clusters"](spark, DATA).collect()
    assert sorted((r.llr for r in out), reverse=True) == pytest.approx(sorted((v[2] for v in found.values()), reverse=True)[:5], abs=1e-5)
    for r in out:
        assert found[r.lat, r.lon, r.km, r.first, r.last] == pytest.approx((r.observed, r.expected, r.llr), abs=1e-5)
        assert 1 <= round(r.p * 100) <= 100 and r.p * 100 == pytest.approx(round(r.p * 100), abs=1e-3)


def test_k_nearest_far(spark):
    """Points that have fewer than k others within the first distance, down to one at the other side of the earth."""
    points = [(i, 40 + i % 4 * 0.01 + i * 0.0007, 5 + i * 0.013) for i in range(12)] + [(20, 47.0, 9.0), (21, -41.0, -179.5), (22, -41.3, 179.7), (23, 88.0, 100.0)]
    expected = set()
    for i, *p in points:
        expected |= {(i, j) for _, j in sorted((km(p, q), j) for j, *q in points if j != i)[:3]}
    rows = spatial.k_nearest(spark.createDataFrame(points, "id long, lat double, lon double"), 3).collect()
    assert {(r.a, r.b) for r in rows} == expected and len(rows) == len(expected)
    assert all(r.weight == pytest.approx(1 / 3) for r in rows)


def shared_places(n=240):
    """Points of which many share a place, some are alone, one has no place and one no value."""
    rows = [(i, 40 + i % 30 * 0.09, 5 + i % 30 * 0.07, float(i * i % 101)) for i in range(n)] + [(900, -30.0, 100.0, 5.0), (901, None, 5.0, 7.0), (902, 40.0, 5.0, None), (903, -20.0, 10.0, 1.0), (904, -20.0, 10.0, 90.0)]
    return rows, "id long, lat double, lon double, value double"


def same_rows(one, other):
    show = lambda df: sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in df.select(sorted(df.columns)).collect()), key=str)
    assert show(one) == show(other)


@pytest.mark.parametrize("method", ["moran", "local_moran", "getis_ord"])
def test_band_by_place(spark, method):
    """Sums by place are those over all pairs, which are not made."""
    points = spark.createDataFrame(*shared_places()).coalesce(2)
    values, f = points.select("id", "value"), getattr(spatial, method)
    same_rows(f(values, spatial.Band(points, 30)), f(values, spatial.distance_band(points, 30)))


@pytest.mark.parametrize("method", ["moran_permutations", "local_moran_permutations", "getis_ord_permutations"])
def test_permutations_by_place(spark, monkeypatch, method):
    """The same p whether pairs are made or not, and whether a task has all values or the cluster does."""
    points = spark.createDataFrame(*shared_places(80)).coalesce(2).na.drop(subset=["value"])
    values, f = points.select("id", "value"), getattr(spatial, method)
    by_place = f(values, spatial.Band(points, 30), 19).cache()
    same_rows(by_place, f(values, spatial.distance_band(points, 30), 19))
    monkeypatch.setattr(spatial, "ONE_TASK", 5)
    same_rows(by_place, f(values, spatial.Band(points, 30), 19))


def test_pairs_by_place(spark):
    """Pairs, circles and clusters of points that share places are those of the points one by one."""
    points = spark.createDataFrame(*shared_places(120)).coalesce(2)
    rows = [r for r in points.collect() if r.lat is not None]
    near = {(p.id, q.id): km((p.lat, p.lon), (q.lat, q.lon)) for p in rows for q in rows}
    within = lambda d: {pair for pair, far in near.items() if far <= d}
    found = spatial.distance_pairs(points, 30, listed=2).collect()
    assert {(r.a, r.b) for r in found} == within(30) and len(found) == len(within(30))
    assert all(r.km == pytest.approx(near[r.a, r.b], abs=1e-6) for r in found)
    around = {p.id: sorted(b for a, b in within(30) if a == p.id) for p in rows}
    assert {(r.center, r.member_count, r.lowest) for r in features.circles(points, 30, 3).collect()} == {(i, len(own), own[0]) for i, own in around.items() if len(own) >= 3}
    # DBSCAN: core points that reach one another, and all points that a core point of a cluster reaches.
    around = {p.id: [b for a, b in within(8) if a == p.id] for p in rows}
    core, label = {i for i, own in around.items() if len(own) >= 5}, {}
    for i in sorted(core):
        todo = [] if i in label else [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += [b for b in around[j] if b in core]
    out = [tuple(r) for r in spatial.dbscan(points, 8, 5).select("id", "cluster", "core").collect()]
    assert set(out) == {(b, label[a], b in core) for a in core for b in around[a]} and len(out) == len(set(out))


@pytest.mark.parametrize("within", [None, 30])
def test_k_nearest_shared(spark, within):
    points = spark.createDataFrame(*shared_places(120)).coalesce(2)
    rows = [r for r in points.collect() if r.lat is not None]
    expected = set()
    for p in rows:
        own = sorted((round(km((p.lat, p.lon), (q.lat, q.lon)), 6), q.id) for q in rows if q.id != p.id)
        own = [j for far, j in own if within is None or far <= within][:3]
        expected |= {(p.id, j, round(1 / len(own), 9)) for j in own}
    found = [(r.a, r.b, round(r.weight, 9)) for r in spatial.k_nearest(points, 3, within=within).collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_k_nearest_one_file(spark):
    """Points that one task reads are answered by all tasks."""
    points = spark.createDataFrame(*shared_places(120)).coalesce(1)
    assert spatial.k_nearest(points, 3).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_screen_clusters_shared(spark):
    """Points of one place have one seed; points without a place stay as they are."""
    points = spark.createDataFrame(*shared_places(90)).coalesce(2)
    alone = points.dropDuplicates(["lat", "lon"]).where("lat is not null").count()
    found = {r.id: r.seed for r in features.screen_clusters(points, 6, 15).collect()}
    assert len(found) == 95 and found[901] == 901 and found[903] == found[904] == 903 and found[902] == found[0] == 0
    assert all(found[i] == found[i % 30] for i in range(90)) and len(set(found.values())) < alone
