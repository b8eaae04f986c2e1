"""Data quality: a profile of every field, duplicates, and rules of validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.cells import ratio
from cohortlab.functions.missing import blank, finite, trimmed


def profile(df: DataFrame, rules: dict[str, list[dict]] = {}) -> DataFrame:
    """field, present, missing, completeness, violations: one pass over the records."""
    stats = [F.count("*").alias("n")]
    for c in df.columns:
        broken = [violates(df, c, r) for r in rules.get(c, [])]
        stats += [F.count(F.when(~blank(F.col(f"`{c}`")), 1)).alias(f"p_{c}"), sum([F.count(F.when(b, 1)) for b in broken], F.lit(0)).cast("long").alias(f"v_{c}")]
    one = df.agg(*stats)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`p_{c}`").alias("present"), F.col(f"`v_{c}`").alias("violations")) for c in df.columns])
    out = one.select("n", F.explode(rows).alias("r"))
    return out.select("r.field", "r.present", (F.col("n") - F.col("r.present")).alias("missing"), ratio(F.col("r.present"), F.col("n")).alias("completeness"), "r.violations")


def violates(df: DataFrame, name: str, rule: dict) -> Column:
    """Whether a value breaks a rule; only ``required`` minds missing values."""
    c = F.col(f"`{name}`")
    kind = rule["type"]
    if kind == "required":
        return blank(c)
    if kind == "range":
        x = finite(df, name)
        out = x.isNull() | F.lit(False)
        out = out | (x < rule["min"]) if rule.get("min") is not None else out
        out = out | (x > rule["max"]) if rule.get("max") is not None else out
    elif kind == "legal-values":
        out = ~trimmed(c).isin(*rule["values"])
    elif kind == "pattern":
        out = ~trimmed(c).rlike(f"^(?:{rule['pattern']})$")
    elif kind == "coordinate":
        x, most = finite(df, name), 90.0 if rule.get("axis", "latitude") == "latitude" else 180.0
        out = x.isNull() | (F.abs(x) > most)
    else:
        raise ValueError(f"unknown rule {kind}")
    return ~blank(c) & F.coalesce(out, F.lit(True))


def issues(df: DataFrame, key: str, rules: dict[str, list[dict]]) -> DataFrame:
    """key, field, rule, severity: a row for every broken rule. ``unique`` compares trimmed, whatever the case."""
    found, rows = [], df
    for name, own in rules.items():
        for rule in own:
            if rule["type"] == "unique":
                fold = F.when(~blank(F.col(f"`{name}`")), F.lower(trimmed(F.col(f"`{name}`"))))
                # Missing values get a key of their own each, so that no task sees them all.
                spread = F.when(fold.isNull(), F.xxhash64(F.col(f"`{key}`")))
                rows = rows.withColumn(f"_u_{name}", F.count("*").over(Window.partitionBy(fold, spread)))
                broken = (F.col(f"_u_{name}") > 1) & ~blank(F.col(f"`{name}`"))
            else:
                broken = violates(df, name, rule)
            found.append(F.when(broken, F.struct(F.lit(name).alias("field"), F.lit(rule["type"]).alias("rule"), F.lit(rule.get("severity", "error")).alias("severity"))))
    return rows.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select(key, "i.*")


def duplicates(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Groups of records that agree on the fields (all of them by default): the fields, and how many."""
    names = fields or df.columns
    return df.groupBy(*names).agg(F.count("*").alias("records")).where("records > 1")
