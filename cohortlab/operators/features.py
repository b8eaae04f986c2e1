"""Map features: filters, geometry repair, joins with data, classes, time stops, circles and clusters on a screen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.missing import blank, number, trimmed
from cohortlab.operators.spatial import place_links, places_of
from cohortlab.sources.scratch import Cuts


def point_filter(c: Column, operator: str, value: str = "") -> Column:
    """The nine operators of a layer's filter. Where both sides read as numbers they compare by value, else as texts
    whatever the case; a missing value reads like the empty text."""
    own = F.coalesce(trimmed(c), F.lit(""))
    if operator in ("is-empty", "is-not-empty"):
        return (own == "") if operator == "is-empty" else (own != "")
    if operator == "contains":
        return F.contains(F.lower(own), F.lit(value.lower()))
    x, y = number(own), number(F.lit(value))
    tests = {
        "equals": lambda p, q: p == q, "not-equals": lambda p, q: p != q, "greater-than": lambda p, q: p > q,
        "greater-or-equal": lambda p, q: p >= q, "less-than": lambda p, q: p < q, "less-or-equal": lambda p, q: p <= q,
    }
    if operator not in tests:
        raise ValueError(f"unknown operator {operator}")
    return F.when(x.isNotNull() & y.isNotNull(), tests[operator](x, y)).otherwise(tests[operator](F.lower(own), F.lit(value.lower())))


def repair(features: DataFrame, line: str = "points", ring: str = "ring") -> DataFrame:
    """A line or ring of each feature with coordinates that are no places left out, neighbours that repeat taken once, and
    rings closed; what was found, whether anything changed, and whether the original was valid (repeats do not mind)."""
    p = F.coalesce(F.col(line), F.array().cast("array<array<double>>"))
    place = lambda v: F.coalesce((F.size(v) >= 2) & (F.abs(F.get(v, F.lit(0))) <= 180) & (F.abs(F.get(v, F.lit(1))) <= 90), F.lit(False))
    differ = lambda v, w: (v[0] != w[0]) | (v[1] != w[1])
    out = features.withColumn("_known", F.filter(p, place))
    out = out.withColumn("_once", F.filter("_known", lambda v, i: (i == 0) | differ(v, F.get("_known", F.greatest(i - 1, F.lit(0))))))
    first, last = F.get("_once", F.lit(0)), F.get("_once", F.size("_once") - 1)
    open_ = F.col(ring) & (F.size("_once") > 0) & F.coalesce(differ(first, last), F.lit(False))
    codes = [
        (F.col(line).isNull(), "missing-geometry"), (F.size("_known") < F.size(p), "invalid-coordinate"), (F.size("_once") < F.size("_known"), "duplicate-vertex"),
        (F.col(line).isNotNull() & F.col(ring) & (F.size("_once") < 4), "ring-too-short"), (open_, "ring-not-closed"),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(code)) for test, code in codes]), lambda c: c.isNotNull())
    fixed = F.when(F.col(line).isNotNull(), F.when(open_, F.concat("_once", F.array(first))).otherwise(F.col("_once")))
    out = out.withColumns({"repaired": fixed, "found": found})
    bad = F.exists("found", lambda c: c.isin("missing-geometry", "invalid-coordinate", "ring-too-short", "ring-not-closed"))
    return out.withColumns({"changed": ~F.col("repaired").eqNullSafe(F.col(line)), "valid": ~bad}).drop("_known", "_once")


def dot_density_join(shapes: DataFrame, data: DataFrame, shape_key: str, data_key: str, fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """(boundaries with their data, counts of the diagnostics). A boundary whose key another has too is left out; a key
    with several data records gives a row for each, and is named ambiguous once a boundary."""
    prepared = lambda c: F.when(~blank(F.col(c)), F.lower(trimmed(F.col(c))) if fold else F.col(c).cast("string"))
    left, right = shapes.withColumn("_k", prepared(shape_key)), data.withColumn("_d", prepared(data_key))
    # Counts by key first: no window, so missing keys and frequent ones never meet in one task.
    boundaries = left.where("_k is not null").groupBy("_k").agg(F.count("*").alias("_b"))
    records = right.where("_d is not null").groupBy("_d").agg(F.count("*").alias("_m"))
    both = boundaries.join(records, F.col("_k") == F.col("_d"), "full").persist()
    single = left.join(both.where("_b = 1 and _m > 0").select(F.col("_k").alias("_only")), F.col("_k") == F.col("_only"), "left_semi")
    joined = single.join(right, F.col("_k") == F.col("_d")).drop("_k", "_d")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by_key = both.agg(
        total(F.when((F.col("_b") == 1) & F.col("_m").isNull(), 1)).alias("unmatched-boundary"), total(F.when(F.col("_b") > 1, F.col("_b"))).alias("duplicate-boundary-key"),
        total(F.when((F.col("_b") == 1) & (F.col("_m") > 1), 1)).alias("duplicate-data-key"), total(F.when(F.coalesce("_b", F.lit(0)) != 1, F.col("_m"))).alias("unmatched-data"),
    )
    missing = left.agg(F.count(F.when(F.col("_k").isNull(), 1)).alias("missing-boundary-key")).join(right.agg(F.count(F.when(F.col("_d").isNull(), 1)).alias("missing-data-key")))
    one = by_key.join(missing)  # one row each
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"`{c}`").cast("long").alias("records")) for c in one.columns])
    return joined, one.select(F.explode(rows).alias("r")).select("r.*").where("records > 0")


def classify(c: Column, breaks: list[float]) -> Column:
    """The first class whose upper bound is not below the value; null above the last."""
    out = F.lit(None).cast("int")
    for i, top in reversed(list(enumerate(breaks))):
        out = F.when(c <= top, F.lit(i)).otherwise(out)
    return out


def time_stops(points: DataFrame, when: str) -> DataFrame:
    """stop, points: how many points a map shows at each time, in order."""
    return points.where(F.col(when).isNotNull()).groupBy(F.col(when).alias("stop")).agg(F.count("*").alias("points")).orderBy("stop")


def circles(points: DataFrame, km: float, least: int) -> DataFrame:
    """center, member_count, lowest: every point with at least so many (itself included) within the distance, the largest
    first. Circles overlap; ``lowest`` is the smallest id inside."""
    members = places_of(points).select("id", "place")
    places = Cuts(points.sparkSession, "circles").cut(members.groupBy("place").agg(F.count("*").alias("k"), F.min("id").alias("first")))
    near = place_links(places, km).join(places.withColumnRenamed("place", "b"), "b").groupBy(F.col("a").alias("place")).agg(F.sum("k").alias("member_count"), F.min("first").alias("lowest"))
    own = members.join(near.where(F.col("member_count") >= least), "place")
    return own.select(F.col("id").alias("center"), "member_count", "lowest").orderBy(F.desc("member_count"), "center")


#: Fixed value: where web maps cut the Mercator projection.
MERCATOR_EDGE = 85.0511287798066


def screen_clusters(points: DataFrame, zoom: float, radius: float = 15) -> DataFrame:
    """id, seed: points on a screen of 256 x 2^zoom pixels, gathered greedily. In the order of ids a point that no earlier seed
    has within ``radius`` pixels is a seed itself, and takes the points around it that none before took. Rounds decide it:
    a point is a seed once all earlier points near it are known to be none, so chains of neighbours take rounds, not n."""
    scale = 256 * 2.0**zoom
    lat = F.radians(F.greatest(F.lit(-MERCATOR_EDGE), F.least(F.lit(MERCATOR_EDGE), F.col("lat"))))
    cuts = Cuts(points.sparkSession, "screen")
    # Points of one place go to the same seed as the first of them, so that one is decided.
    members = places_of(points).select("id", "place")
    points, whole = cuts.cut(members.groupBy("place").agg(F.min("id").alias("id")).select("id", "place", "place.lat", "place.lon"), "places"), points
    placed = points.select("id", ((F.col("lon") + 180) / 360 * scale).alias("x"), ((1 - F.ln(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2 * scale).alias("y"))
    placed = placed.withColumns({"r": F.floor(F.col("x") / radius), "c": F.floor(F.col("y") / radius)})
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = placed.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("r") + F.col("i")).alias("r"), (F.col("c") + F.col("j")).alias("c"))
    b = placed.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "r", "c")
    apart = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    near = cuts.cut(a.join(b, ["r", "c"]).where((F.col("a") < F.col("b")) & (apart <= radius)).select("a", "b"), "near")  # a before b
    left, seeds = cuts.cut(points.select("id"), "left"), None
    edges = near
    while not left.isEmpty():
        now = left.join(edges.select(F.col("b").alias("id")), "id", "left_anti")
        now = cuts.cut(now, "now")
        seeds = now if seeds is None else cuts.cut(seeds.unionByName(now), "seeds")
        gone = cuts.cut(now.unionByName(edges.join(now.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))).distinct(), "gone")
        left = cuts.cut(left.join(gone, "id", "left_anti"), "left")
        edges = cuts.cut(edges.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti"), "edges")
    if seeds is None:
        return whole.select("id", F.col("id").alias("seed"))
    first = near.join(seeds.select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("first"))
    own = seeds.select("id", F.col("id").alias("own"))
    decided = points.select("id", "place").join(own, "id", "left").join(first, "id", "left").select("place", F.coalesce("own", "first").alias("seed"))
    alone = whole.join(members.select("id"), "id", "left_anti").select("id", F.col("id").alias("seed"))  # no place
    return members.join(decided, "place").select("id", "seed").unionByName(alone)


def with_row_context(df: DataFrame, unique: dict[str, list[str]] = {}, count: str | None = None) -> DataFrame:
    """RECORDCOUNT and ISUNIQUE as columns: ``count`` names the column of the number of records; ``unique`` gives for each new
    column the fields whose values, all present, no other record has together (texts trimmed, whatever the case)."""
    out = df
    for name, fields in unique.items():
        keys = {f"_u{i}": F.lower(trimmed(F.col(f"`{f}`"))) for i, f in enumerate(fields)}
        whole = F.lit(True)
        for f in fields:
            whole = whole & ~blank(F.col(f"`{f}`"))
        some = out.where(whole).withColumns(keys).withColumn(name, F.count("*").over(Window.partitionBy(*keys)) == 1).drop(*keys)
        out = some.unionByName(out.where(~whole).withColumn(name, F.lit(False)))
    if count:
        out = out.join(F.broadcast(df.agg(F.count("*").alias(count))))  # one row
    return out


def auto_search(df: DataFrame, record: dict[str, object], fields: list[str], order: list[str], shown: int = 25) -> DataFrame:
    """The first records, by ``order``, that agree with the current one on every search field that it has a value for; the limit
    is what the search shows."""
    fits = F.lit(bool([f for f in fields if record.get(f) not in (None, "")]))
    for f in fields:
        if record.get(f) not in (None, ""):
            fits = fits & (F.lower(trimmed(F.col(f"`{f}`"))) == str(record[f]).strip().lower())
    return df.where(fits).orderBy(*order).limit(shown)
