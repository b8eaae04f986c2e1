"""Relations: RELATE, MERGE, import merges, DELETE and UNDELETE, SORT, RECODE, key joins with diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.missing import blank, empty, finite, trimmed


def relate_key(df: DataFrame, name: str) -> Column:
    """Numbers by value, truth values as text, others exactly as they are; the empty text is missing."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("double", "float", "integer", "long", "short", "byte", "decimal"):
        return finite(df, name)
    c = F.col(f"`{name}`")
    return F.when(~empty(c), F.lower(c.cast("string")) if kind == "boolean" else c.cast("string"))


def free_names(taken: list[str], wanted: list[str]) -> dict[str, str]:
    """For each wanted name the first free one: itself, or with 2, 3, ... after it; case does not matter."""
    used, out = {t.lower() for t in taken}, {}
    for name in wanted:
        new, k = name, 2
        while new.lower() in used:
            new, k = f"{name}{k}", k + 1
        used.add(new.lower())
        out[name] = new
    return out


def relate(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], keep_all: bool = False) -> DataFrame:
    """An equi-join in which missing keys never match; with ``keep_all`` unmatched records of the left stay. Fields of
    the right whose names are taken get a number."""
    names = free_names(left.columns, right.columns)
    lk = {f"_k{i}": relate_key(left, a) for i, (a, _) in enumerate(keys)}
    rk = {f"_r{i}": relate_key(right, b) for i, (_, b) in enumerate(keys)}
    right = right.withColumns(rk).select(*[F.col(f"`{o}`").alias(n) for o, n in names.items()], *rk)
    on = reduce(lambda x, y: x & y, [F.col(f"_k{i}") == F.col(f"_r{i}") for i in range(len(keys))])
    return left.withColumns(lk).join(right, on, "left" if keep_all else "inner").drop(*lk, *rk)


def merge(target: DataFrame, source: DataFrame, keys: list[tuple[str, str]], order: list[str]) -> DataFrame:
    """A keyed upsert. Matched records take the source's shared fields, nulls included; others, and those with a
    missing key, are added. Of several source records with one key the last by ``order`` wins. A key that the target
    holds twice is an error, found while the result is computed."""
    tk, sk = [f"_t{i}" for i in range(len(keys))], [f"_s{i}" for i in range(len(keys))]
    target = target.withColumns({n: relate_key(target, a) for n, (a, _) in zip(tk, keys)})
    whole = reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in tk])
    copies = F.count("*").over(Window.partitionBy(*tk))
    # Records with a missing key meet no window, which would put them all into one task.
    target = target.where(whole).withColumn("_n", copies).unionByName(target.where(~whole).withColumn("_n", F.lit(1).cast("long")))
    target = target.withColumn("_t", F.when(whole & (F.col("_n") > 1), F.raise_error(F.lit("duplicate key in the target"))).otherwise(F.lit(1)))
    source = source.withColumns({n: relate_key(source, b) for n, (_, b) in zip(sk, keys)})
    full = reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in sk])
    last = F.row_number().over(Window.partitionBy(*sk).orderBy(*[F.desc(o) for o in order]))
    kept = source.where(full).withColumn("_k", last).where("_k = 1").drop("_k").unionByName(source.where(~full)).withColumn("_s", F.lit(1))
    renamed = kept.select(*[F.col(f"`{c}`").alias(f"src_{c}") if c not in (*sk, "_s") else F.col(c) for c in kept.columns])
    on = reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in zip(tk, sk)])
    both = target.join(renamed, on, "full")
    key_of = {a.lower(): b for a, b in keys}
    shared = {c.lower(): c for c in kept.columns}
    out = []
    for c in [c for c in target.columns if c not in (*tk, "_n", "_t")]:
        own = F.col(f"`{c}`")
        given = shared.get(key_of.get(c.lower(), c).lower())
        if c.lower() in key_of:
            out.append(F.when(F.col("_t").isNotNull(), own).otherwise(F.col(f"src_{key_of[c.lower()]}")).alias(c))
        elif given:
            out.append(F.when(F.col("_s").isNotNull(), F.col(f"src_{given}")).otherwise(own).alias(c))
        else:
            out.append(own)
    return both.select(*out)


def import_merge(target: DataFrame, source: DataFrame, key: str, mode: str = "update-and-append") -> DataFrame:
    """The four import modes. Keys match trimmed and whatever the case; blank incoming cells do not overwrite. A key that
    either side holds twice is an error, found while the result is computed; records without a key match nothing."""
    if mode == "replace":
        return source
    fold = lambda c: F.lower(trimmed(F.col(f"`{c}`")))


    def single(rows: DataFrame, name: str, side: str) -> DataFrame:
        some = rows.where(F.col(name).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(name)))
        checked = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate key in the {side}")).cast("string")).otherwise(F.col(name))
        return some.withColumn(name, checked).drop("_n").unionByName(rows.where(F.col(name).isNull()))

    keyed = F.when(~blank(F.col(f"`{key}`")), fold(key))
    renamed = single(source.withColumn("_s", keyed), "_s", "source").select(*[F.col(f"`{c}`").alias(f"src_{c}") for c in source.columns], "_s")
    target_columns, target = target.columns, single(target.withColumn("_t", keyed), "_t", "target")
    how = {"update-and-append": "full", "update-only": "left", "append-new": "full"}[mode]
    both = target.withColumn("_here", F.lit(True)).join(renamed, F.col("_t") == F.col("_s"), how)
    out = []
    for c in target_columns:
        if c not in source.columns:
            out.append(F.col(c))
            continue
        given = F.when(~blank(F.col(f"src_{c}")), F.col(f"src_{c}"))
        kept = F.coalesce(F.col(c), given) if mode == "append-new" else F.coalesce(given, F.col(c))
        out.append(F.when(F.col("_here").isNull(), F.col(f"src_{c}")).otherwise(F.col(c) if mode == "append-new" or c == key else kept).alias(c))
    return both.select(*out)


def import_preview(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """How many incoming records are new, matching, changed, unchanged, duplicated or without a key."""
    fold = lambda c: F.lower(trimmed(F.col(f"`{c}`")))
    shared = [c for c in source.columns if c in target.columns and c != key]
    changes = [~blank(F.col(f"src_{c}")) & ~F.col(f"src_{c}").eqNullSafe(F.col(c)) for c in shared]
    own = source.select(*[F.col(f"`{c}`").alias(f"src_{c}") for c in source.columns], F.when(~blank(F.col(key)), fold(key)).alias("_s"))
    copies = F.count("*").over(Window.partitionBy("_s"))
    own = own.where("_s is not null").withColumn("_n", copies).unionByName(own.where("_s is null").withColumn("_n", F.lit(1).cast("long")))
    both = own.join(target.withColumn("_t", fold(key)), F.col("_s") == F.col("_t"), "left")
    changed = reduce(lambda x, y: x | y, changes, F.lit(False))
    met, some = F.col("_t").isNotNull(), F.col("_s").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(
        count(some & ~met).alias("new"), count(met).alias("matching"), count(met & changed).alias("changed"), count(met & ~changed).alias("unchanged"),
        count(some & (F.col("_n") > 1)).alias("duplicate_key"), count(~some).alias("blank_key"),
    )


def candidate_keys(df: DataFrame) -> DataFrame:
    """Fields that are complete and unique, in one pass: field, present, distinct, is_key."""
    stats = df.agg(F.count("*").alias("n"), *[x for c in df.columns for x in (F.count(F.when(~blank(F.col(c)), 1)).alias(f"p_{c}"), F.count_distinct(F.when(~blank(F.col(c)), F.lower(trimmed(F.col(c))))).alias(f"d_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"p_{c}").alias("present"), F.col(f"d_{c}").alias("distinct_values")) for c in df.columns])
    return stats.select("n", F.explode(rows).alias("r")).select("r.*", ((F.col("r.present") == F.col("n")) & (F.col("r.distinct_values") == F.col("n"))).alias("is_key"))


def import_keys(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fields of both tables as merge keys: field, present, distinct_values (of the incoming), is_key (complete and unique on
    both sides) and a score of how much its name reads like an identifier's."""
    shared = [c for c in incoming.columns if c in current.columns]
    own, other = candidate_keys(incoming.select(*shared)), candidate_keys(current.select(*shared))
    name = F.lower("field")
    compact = F.regexp_replace(name, "[^a-z0-9]", "")
    named = compact.rlike(r"^(id|uid|uuid|guid|globalrecordid)$") | compact.rlike(r"(case|record|person|patient|subject)id$") | name.rlike(r"_id$")
    score = F.when(name == "globalrecordid", 100).otherwise(0) + F.when(named, 40).otherwise(0) + F.when(name.rlike(r"(^|[_\s])identifier($|[_\s])"), 20).otherwise(0)
    both = own.join(other.select("field", F.col("is_key").alias("_other")), "field")
    return both.select("field", "present", "distinct_values", (F.col("is_key") & F.col("_other")).alias("is_key"), score.alias("score"))


def delete(df: DataFrame, matched: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bag difference: as many copies of each record go as were matched, the earliest first. (kept, deleted)"""
    fields = df.columns
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(*fields).orderBy(*order)))
    gone = matched.groupBy(*fields).agg(F.count("*").alias("_gone"))
    same = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in fields])
    both = ranked.alias("l").join(gone.alias("r"), same, "left").select("l.*", F.coalesce("r._gone", F.lit(0)).alias("_gone"))
    return both.where("_i > _gone").select(*fields), both.where("_i <= _gone").select(*fields)


def undelete(kept: DataFrame, archive: DataFrame, position: str) -> DataFrame:
    """Archived records back at the place they carry."""
    return kept.unionByName(archive, allowMissingColumns=True).orderBy(position)


def sort(df: DataFrame, fields: list[tuple[str, bool]], row: str | None = None) -> DataFrame:
    """fields: (name, descending). Missing comes first upwards and last downwards; texts compare in lower case; equal
    records keep the order of ``row``."""
    keys = []
    for name, down in fields:
        c = F.col(f"`{name}`")
        if df.schema[name].dataType.typeName() == "string":
            c = F.when(~blank(c), F.lower(c))
        keys.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return df.orderBy(*keys, *([row] if row else []))


def recode(df: DataFrame, source: str, target: str, ranges: list[tuple[float | None, float | None, str]], other: str | None = None) -> DataFrame:
    """ranges: (above, up to, label), null for no bound; the first that fits. ``other`` also takes missing values."""
    x, out = finite(df, source), F.lit(other).cast("string")
    for above, up_to, label in reversed(ranges):
        fits = x.isNotNull()
        fits = fits & (x > above) if above is not None else fits
        fits = fits & (x <= up_to) if up_to is not None else fits
        out = F.when(fits, F.lit(label)).otherwise(out)
    return df.withColumn(target, out)


def key_join(shapes: DataFrame, data: DataFrame, shape_key: str, data_key: str, fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """Boundaries with data, and what became of every record: (joined, counts of the diagnostic classes). Data whose
    key names several boundaries is withheld."""
    prepared = lambda c: F.when(~blank(F.col(c)), F.lower(trimmed(F.col(c))) if fold else F.col(c).cast("string"))

    def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
        some = rows.where(F.col(key).isNotNull()).withColumn(name, F.count("*").over(Window.partitionBy(key)))
        return some.unionByName(rows.where(F.col(key).isNull()).withColumn(name, F.lit(1).cast("long")))

    left = counted(shapes.withColumn("_k", prepared(shape_key)), "_k", "_n")
    right = counted(data.withColumn("_d", prepared(data_key)), "_d", "_m")
    single = left.where("_k is not null and _n = 1")
    names = free_names(shapes.columns, data.columns)
    joined = single.join(right, F.col("_k") == F.col("_d")).select(*shapes.columns, *[right[c].alias(n) for c, n in names.items()])
    keys_l, keys_r = left.select("_k", "_n"), right.select("_d", "_m")
    known = keys_l.where("_k is not null").groupBy("_k").agg(F.max("_n").alias("_b"))
    of_data = keys_r.join(known, F.col("_d") == F.col("_k"), "left").select(
        F.when(F.col("_d").isNull(), "data-key-missing").when(F.col("_b").isNull(), "data-unmatched").when(F.col("_b") > 1, "data-ambiguous")
        .when(F.col("_m") > 1, "data-matched-many").otherwise("data-matched").alias("class"))
    has = keys_r.where("_d is not null").select(F.col("_d").alias("_h")).distinct()
    of_shapes = keys_l.join(has, F.col("_k") == F.col("_h"), "left").select(
        F.when(F.col("_k").isNull(), "boundary-key-missing").when(F.col("_n") > 1, "boundary-duplicate").when(F.col("_h").isNull(), "boundary-unmatched")
        .otherwise("boundary-matched").alias("class"))
    return joined, of_data.unionAll(of_shapes).groupBy("class").agg(F.count("*").alias("records"))
