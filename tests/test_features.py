"""Features, ranking, readers, sessions and queries that SQL cannot express, against brute force."""

import math
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from cohortlab import queries as engine
from cohortlab.functions import kernels, samples
from cohortlab.operators import features, ranking, relational, spatial, tabulate
from cohortlab.plans.expressions import evaluate, parse
from cohortlab.plans.session import Session
from cohortlab.sources import readers
from cohortlab.streaming import epi_stream

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_prefix_sums(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randint(0, 50), r.randint(1, 5)) for _ in range(300)]
    rows = [(g, v, k) for (g, v), k in {(g, v): k for g, v, k in rows}.items()] + [(None, 3, 2), (None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    for by in ([], ["g"]):
        found = {(x.g, x.v): (x.up, x.total) for x in ranking.prefix_sums(df, ["v"] if by else ["v", "g"], "k", "up", "total", by).collect()}
        for g, v, k in rows:
            mine = [x for x in rows if not by or x[0] == g]
            before = [x for x in mine if (x[1] <= v if by else (x[1], x[0] is not None, x[0] or "") <= (v, g is not None, g or ""))]
            assert found[g, v] == (sum(x[2] for x in before), sum(x[2] for x in mine))


def test_freq_by_ranges(spark, monkeypatch):
    """The same rows whether one task orders the categories or ranges do."""
    df = spark.createDataFrame([(i % 37, i % 3) for i in range(500)], "x int, s int")
    show = lambda: [sorted(map(str, tabulate.freq(df, "x", s).collect())) for s in (None, "s")]
    whole = show()
    monkeypatch.setattr(tabulate, "ONE_TASK", 5)
    assert show() == whole


def test_means_quartiles(spark):
    r = random.Random(4)
    rows = [(None if i % 9 == 0 else i % 3, float(r.randint(0, 9))) for i in range(100)]
    out = tabulate.means(spark.createDataFrame(rows, "g int, x double"), "x", ["g"]).collect()
    for found in out:
        v = sorted(x for g, x in rows if g == found.g)
        for p, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
            at = len(v) * p
            expected = (v[int(at) - 1] + v[int(at)]) / 2 if at == int(at) else v[math.ceil(at) - 1]
            assert found[name] == expected
        assert found["mode"] == min(v, key=lambda x: (-v.count(x), x)) and found.n == len(v)
    assert len(out) == 4


def test_tables_bounds(spark, monkeypatch):
    monkeypatch.setattr(tabulate, "MOST_CELLS", 50)
    with pytest.raises(ValueError, match="cells"):
        tabulate.tables(spark.range(100).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).alias("b")), "a", "b")


def test_fisher_golden(spark):
    """Counts and p of a published example."""
    rows = [(e, o) for e, own in (("No", (0, 40, 2, 6)), ("Yes", (22, 12, 14, 0))) for o, k in enumerate(own) for _ in range(k)]
    out = tabulate.fisher_tables(tabulate.tables(spark.createDataFrame(rows, "e string, o int"), "e", "o")).first()
    assert out.fisher_p == pytest.approx(5.552362909835065e-14, rel=1e-5) and (out.n_rows, out.n_cols) == (2, 4)


def test_sample_size_golden(spark):
    one = spark.range(1)
    sizes = [one.select(samples.survey_size(F.lit(999999), F.lit(50.0), F.lit(5.0), F.lit(1.0), F.lit(1), x)).first()[0] for x in (0.8, 0.9, 0.95, 0.97, 0.99, 0.999, 0.9999)]
    assert sizes == [164, 270, 384, 471, 663, 1082, 1512]
    cohort = one.select(*[c.alias(n) for n, c in samples.comparison_sizes(F.lit(0.05), F.lit(24.0), F.lit(1.0), 0.95, 0.8).items()]).first()
    assert (cohort.kelsey_first, cohort.fleiss_first, cohort.fleiss_cc_first) == (13, 12, 16)
    cases = one.select(*[c.alias(n) for n, c in samples.comparison_sizes(F.lit(0.4), F.lit(10.0), F.lit(1.0), 0.95, 0.8).items()]).first()
    assert (cases.kelsey_first, cases.fleiss_first, cases.fleiss_cc_first) == (17, 16, 20)


def greedy(points, zoom, radius):
    scale = 256 * 2**zoom
    place = {i: ((lon + 180) / 360 * scale, (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * scale) for i, lat, lon in points}
    left, out = sorted(place), {}
    while left:
        seed = left[0]
        near = [i for i in left if math.hypot(place[i][0] - place[seed][0], place[i][1] - place[seed][1]) <= radius]
        out |= {i: seed for i in near}
        left = [i for i in left if i not in out]
    return out


def test_screen_clusters(spark):
    r = random.Random(5)
    points = [(i, 40 + r.random() * 3, 5 + r.random() * 3) for i in range(150)] + [(200 + i, 41.0, 5 + i * 0.2) for i in range(20)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    assert {x.id: x.seed for x in features.screen_clusters(df, 7, 15).collect()} == greedy(points, 7, 15)
    assert features.screen_clusters(df.limit(0), 7).count() == 0


@needs_data
def test_screen_query(spark):
    rows = engine.queries()["screen_cluster_points"](spark, DATA).collect()
    keys = [r.c_custkey for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()]
    assert {r.id: r.seed for r in rows} == greedy([(k, k * 7919 % 1000 / 100 + 40, k * 104729 % 1000 / 100 + 5) for k in keys], 6, 15)


@needs_data
def test_linkage_clusters_query(spark):
    """Greedy by score and ids, one pair after the other."""
    customers = [(r.c_custkey, r.c_name, r.c_nationkey, r.c_mktsegment) for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()]
    others = [(i, n[:12] + "x" + n[12:] if i % 4 == 0 else n, k, s if i % 7 else None) for i, n, k, s in customers if i % 5]
    links = [(-(s == t) - (kernels.jaro_winkler(n.lower(), m.lower()) >= 0.97), i, j) for i, n, k, s in customers for j, m, c, t in others if k == c and (s == t) + (kernels.jaro_winkler(n.lower(), m.lower()) >= 0.97) >= 2]
    taken, a, b = set(), set(), set()
    for _, i, j in sorted(links):
        if i not in a and j not in b:
            taken.add((i, j)), a.add(i), b.add(j)
    assert {(r.a_id, r.b_id) for r in engine.queries()["linkage_clusters"](spark, DATA).collect()} == taken


def permuted(spark, ids):
    """The operators' orders: for each replication the ids by hash."""
    hashes: dict[int, list] = {}
    for r in spark.createDataFrame([(i,) for i in ids], "id long").join(spark.range(1, 100).withColumnRenamed("id", "rep")).select("rep", "id", F.xxhash64(F.lit(1), "rep", "id").alias("h")).collect():
        hashes.setdefault(r.rep, []).append((r.h, r.id))
    return {rep: [i for _, i in sorted(own)] for rep, own in hashes.items()}


@needs_data
def test_permutation_queries(spark):
    """The same permutations, by the same hashes, in plain Python."""
    points = [(r.c_custkey, r.c_custkey * 7919 % 1000 / 100 + 40, r.c_custkey * 104729 % 1000 / 100 + 5, r.c_acctbal) for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()]
    mean, n = sum(p[3] for p in points) / len(points), len(points)
    z, ids = {p[0]: p[3] - mean for p in points}, sorted(p[0] for p in points)
    near: dict[int, list] = {}
    for r in spatial.distance_band(spark.createDataFrame([p[:3] for p in points], "id long, lat double, lon double"), 30).orderBy("a", "b").collect():
        near.setdefault(r.a, []).append((r.b, r.weight))
    orders = permuted(spark, ids)
    shuffled = {rep: {place: z[i] for place, i in zip(ids, own)} for rep, own in orders.items()}
    # Global I, about its expectation.
    s0, ss = sum(w for own in near.values() for _, w in own), sum(v * v for v in z.values())
    far = lambda v: abs(n / s0 * sum(w * v[a] * v[b] for a, own in near.items() for b, w in own) / ss + 1 / (n - 1))
    above = sum(far(v) >= far(z) for v in shuffled.values())
    assert engine.queries()["moran_pseudo_p"](spark, DATA).first().p == pytest.approx((above + 1) / 100)
    # Gi*.
    found = {r.id: r for r in engine.queries()["getis_ord_simulated"](spark, DATA).collect()}
    for i in ids:
        if i not in near:
            assert (found[i].kind, found[i].gi_star, found[i].z, found[i].p) == ("isolated", None, None, None)
            continue
        total = lambda v, i=i: v[i] + sum(w * v[b] for b, w in near[i])
        sims = [total(v) for v in shuffled.values()]
        middle = sum(sims) / 99
        spread = math.sqrt(sum((x - middle) ** 2 for x in sims) / 99)
        assert found[i].z == pytest.approx((total(z) - middle) / spread, abs=1e-6)
        assert found[i].p == pytest.approx((sum(abs(x) >= abs(total(z)) for x in sims) + 1) / 100)
        assert found[i].kind == ("hot" if found[i].z >= 1.96 else "cold" if found[i].z <= -1.96 else "neutral")
    # Local I: others' values that follow one another in the permutation, from a place of its own on, itself left out.
    starts = {(r.rep, r.a): r.s for r in spark.createDataFrame([(i,) for i in ids], "a long").join(spark.range(1, 100).withColumnRenamed("id", "rep")).select("rep", "a", F.pmod(F.xxhash64(F.lit(1), F.lit("start"), "rep", "a"), F.lit(n)).alias("s")).collect()}
    local = {r.id: r for r in engine.queries()["moran_local_simulated"](spark, DATA).collect()}
    for i in ids:
        if i not in near:
            assert local[i].p is None and local[i].quadrant == "isolated"
            continue
        lag = sum(w * z[b] for b, w in near[i])
        hits = 0
        for rep, own in orders.items():
            ring = [own[(starts[rep, i] + 1 + k) % n] for k in range(n)]
            others = [x for x in ring if x != i][: len(near[i])]
            assert len(set(others)) == len(near[i])
            hits += abs(z[i] * sum(w * z[x] for (_, w), x in zip(near[i], others))) >= abs(z[i] * lag)
        assert local[i].p == pytest.approx((hits + 1) / 100)


@needs_data
def test_survey_limits_query(spark):
    """Limits lie t standard errors off the estimate; t by integrating the density."""
    from cohortlab.catalog.surveys import _rows
    from cohortlab.operators import survey

    rows = survey.freq(_rows(spark, DATA), "size", "c_mktsegment", "c_nationkey", "c_acctbal").collect()
    found = {r.value: r for r in engine.queries()["survey_limits"](spark, DATA).collect()}
    for r in rows:
        density = lambda x, v=r.df: math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
        low, high = 0.0, 50.0
        for _ in range(50):
            t = (low + high) / 2
            h = t / 2000
            inside = sum(density(i * h) * (1 if i in (0, 2000) else 4 if i % 2 else 2) for i in range(2001)) * h / 3
            low, high = (t, high) if inside < 0.475 else (low, t)
        assert found[r.value].lcl == pytest.approx(r.proportion - t * r.std_err, abs=2e-6) and found[r.value].ucl == pytest.approx(r.proportion + t * r.std_err, abs=2e-6)


def test_dots(spark):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    sliver = [[0.0, 0.0], [1000.0, 1000.0], [1000.0, 1000.02], [0.0, 0.02]]
    kind = "id long, dots long, rings array<array<array<double>>>"
    out = spatial.place_dots(spark.createDataFrame([(1, 30, [square]), (2, 20, [sliver])], kind)).collect()
    assert sorted(r.id for r in out) == [1] * 30 + [2] * 20
    with pytest.raises(Exception, match="found no place"):
        spatial.place_dots(spark.createDataFrame([(1, 1, [[[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]])], kind), most_tries=5).count()


def test_zone_edges(spark):
    """Left and lower edges belong to a zone, right and upper ones to the next; no point is in two, none is lost."""
    ring = lambda x, y: [[x, y], [x + 2.0, y], [x + 2.0, y + 2.0], [x, y + 2.0]]
    zones = spark.createDataFrame([(10 * i + j, [ring(2.0 * i, 2.0 * j)]) for i in range(5) for j in range(5)] + [(999, [ring(100.0, 100.0)])], "zone int, rings array<array<array<double>>>")
    points = spark.createDataFrame([(x / 2, y / 2) for x in range(20) for y in range(20)], "lon double, lat double")
    found = spatial.zone_join(points, zones).collect()
    assert len(found) == 400 and all(r.zone == 10 * int(r.lon // 2) + int(r.lat // 2) for r in found)


def test_import_merge_unique(spark):
    target = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3"), ("", "4")], "k string, v string")
    source = spark.createDataFrame([(" A ", ""), ("c", "5"), (None, "6")], "k string, v string")
    show = lambda mode: sorted(((r.k or "").strip(), r.v) for r in relational.import_merge(target, source, "k", mode).collect())
    assert show("update-and-append") == [("", "3"), ("", "4"), ("", "6"), ("a", "1"), ("b", "2"), ("c", "5")]
    assert show("update-only") == [("", "3"), ("", "4"), ("a", "1"), ("b", "2")]
    assert show("replace") == [("", "6"), ("A", ""), ("c", "5")]
    with pytest.raises(Exception, match="duplicate key in the source"):
        relational.import_merge(target, source.unionByName(source), "k").collect()


def workbook(path):
    files = {
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Case id</t></si><si><r><t>Na</t></r><r><t>me</t></r></si><si><t>Ann</t></si></sst>',
        "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>Ill</t></is></c></row>'
        '<row><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" t="b"><v>1</v></c></row><row/><row><c r="A4"><v>2.5</v></c><c r="C4" t="b"><v>0</v></c></row></sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)


def test_workbook_and_archive(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    rows = readers.read_xlsx(spark, str(tmp_path / "a.xlsx"))
    assert rows.columns == ["Case_id", "Name", "Ill"] and [tuple(r) for r in rows.collect()] == [("1", "Ann", "true"), ("2.5", "", "false")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        for name in ("in/x.shp", "in/x.shx", "in/x.dbf", "y.shp", "z.gpkg", "../up.shp", "readme.txt"):
            z.writestr(name, b"12345")
    found = {r.entry: (r.bytes, r.kind, r.dataset) for r in readers.archive_inventory(spark, str(tmp_path / "b.zip")).collect()}
    assert found["in/x.shx"] == (5, "shapefile", "in/x") and found["y.shp"][1] == "shapefile-incomplete" and found["z.gpkg"][1:] == ("geopackage", "z")
    assert found["../up.shp"][1] == "unsafe" and found["readme.txt"][1:] == ("other", None)


def test_session_extras(spark):
    table = spark.createDataFrame([(3, "b", "x"), (1, "a", "y"), (2, "c", "x")], "k int, t string, u string").repartition(3)
    session = Session(spark, {"people": table}, {"people": ["k"]})
    out = session.run("READ people\nSORT t DESC\nLIST k")
    assert [r.k for r in out.collect()] == [2, 3, 1]
    assert [r.k for r in session.run("CANCEL SORT\nLIST k").collect()] == [1, 2, 3]
    shown = session.run("DEFINE v NUMERIC\nDISPLAY DBVARIABLES").collect()
    assert [(r.table, r.variable) for r in shown] == [("", "v"), ("people", "k"), ("people", "t"), ("people", "u")]
    assert [r.variable for r in session.run("DISPLAY DBVARIABLES LIST k u").collect()] == ["k", "u"]
    session.run("TABLES t u FISHER")
    assert dict(session.reports)["FISHER t u"].first().fisher_p == pytest.approx(1.0)
    with pytest.raises(Exception):
        session.run("NONSENSE")
    assert [r.outcome for r in session.run_history().collect()][-2:] == ["completed", "failed"]
    session.run("READ people\nUNDEFINE *")
    assert session.variables == {}


def test_division_in_check_code(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    node = parse("a / b")
    assert [r[0] for r in df.select(evaluate(node, df).number).collect()] == [None, 2.0]
    with pytest.raises(Exception, match="division by zero"):
        df.select(evaluate(node, df, strict=True).number).collect()


def test_stream_matches_table(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 4} 10:00:00", "ab"[i % 2]) for i in range(40)], "id int, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    found = epi_stream.run_to_end(spark, str(tmp_path / "events.parquet")).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, epi_stream.curve(rows).collect()))
