"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with those of
its language over the whole table, by Jensen-Shannon distance (square root of the divergence to base 2, so
0 to 1). Both comparisons have minimum-length guards: a text too short for a histogram to mean anything is
not judged by it.

Defined results: a null or empty text has no words and fails the base rules; a null language is compared with the
whole table and has no common words of its own; rows that repeat a doc_id, or have none, are judged each; a distance
equal to its limit passes; an empty table gives an empty result; other columns of the input do not matter. References
are kept for every language, broadcast up to ``broadcast_rows`` of them and joined by a shuffle beyond that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch, let, words

#: Character classes. Lower-case ASCII letters and white space are what one pass strips from the text; the others
#: are counted, as Java patterns of what does not belong, in the short rest. The last class is what none matches.
RARE_CLASSES = {
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "stop": r"[^.,;:!?'\"()\-]+",
    "other_letter": r"[^\p{L}]+|[A-Z]+",
}
CLASSES = ["lower", "space", *RARE_CLASSES]

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that for it as was with".split(),
    "de": "der die und das von zu mit den ist im für auf".split(),
    "fr": "de la le et les des en un du une que dans".split(),
    "es": "de la que el en y a los del se las por".split(),
}


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    repeat_window: int = 5
    min_chars: int = 200
    max_class_distance: float = 0.24
    min_common_text_words: int = 80
    max_common_distance: float = 0.28
    broadcast_rows: int = 10_000
    symbols: str = "[^#*$%&|<>]+"


def repeated_words(tokens: Column, width: int) -> Column:
    """How many words lie in a ``width``-word window that the list holds at least twice."""

    def count(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(
                s,
                lambda e, k: F.coalesce(F.get(s, k - 1)["g"] == e["g"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["g"] == e["g"], F.lit(False)),
            )
            return F.sort_array(F.transform(again, lambda e: e["i"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda v, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1), v + width) - v))
            return F.aggregate(steps, F.lit(0), lambda a, v: a + v)

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
            let(let(pairs, starts), covered)
        )

    def exact(tokens: Column) -> Column:
        return let(
            F.transform(F.sequence(F.lit(1), F.size(tokens) - width + 1), lambda i: F.array_join(F.slice(tokens, i, width), " ")),
            count,
        )

    # A window that is there twice has a hash that is there twice, so only such texts need their windows spelt out.
    hashes = F.transform(tokens, lambda w, i: F.xxhash64(w, *[F.get(tokens, i + k) for k in range(1, width)]))
    unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when((F.size(tokens) <= width) | unique, F.lit(0)).otherwise(exact(tokens)).cast("long")


def _text_features(docs: DataFrame, rules: QualityRules) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    split = docs.select(
        "doc_id", "lang", text.alias("text"), words(F.col("text")).alias("w"),
        F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "").alias("rest"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    word_chars = F.length(F.array_join("w", ""))
    classes = [word_chars - F.length("rest"), F.length("text") - word_chars]
    classes += [F.length(F.regexp_replace("rest", c, "")) for c in RARE_CLASSES.values()]
    common = let(
        F.filter("w", lambda w: w.isin(*every)),
        lambda c: F.transform(listed[F.coalesce("lang", F.lit(""))], lambda x: (F.size(c) - F.size(F.array_remove(c, x))).cast("double")),
    )
    return split.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        F.length(F.regexp_replace("rest", rules.symbols, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w"), rules.repeat_window).alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.transform(F.array(*classes), lambda c: c.cast("double")).alias("classes"),
        F.coalesce(common, F.array().cast("array<double>")).alias("common"),
    )


def _closed(histogram: Column, total: Column) -> Column:
    """The histogram with a last bin for the rest, as shares."""
    whole = F.concat(histogram, F.array(total - F.aggregate(histogram, F.lit(0.0), lambda a, v: a + v)))
    return F.transform(whole, lambda v: v / F.greatest(total, F.lit(1.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two lists of shares, to base 2."""

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(0.0)
        return (part(x) + part(y)) / 2

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def language_references(features: DataFrame) -> DataFrame:
    """One row of two short lists for each language, and one with a null language for the whole table."""
    longest = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"k{i}") for i in range(len(CLASSES))]
    sums += [F.coalesce(F.sum(F.get("common", F.lit(i))), F.lit(0.0)).alias(f"c{i}") for i in range(longest)]
    sums += [F.sum("n_chars").cast("double").alias("chars"), F.sum("n_words").cast("double").alias("tokens")]
    grouped = features.groupBy("lang").agg(*sums)
    total = features.agg(*sums).select(F.lit(None).cast("string").alias("lang"), *[F.col(s) for s in grouped.columns[1:]])
    shape = lambda names, whole: _closed(F.array(*map(F.col, names)), F.col(whole))
    return grouped.where("lang is not null").unionByName(total).select(
        F.col("lang").alias("ref_lang"),
        shape([f"k{i}" for i in range(len(CLASSES))], "chars").alias("ref_classes"),
        shape([f"c{i}" for i in range(longest)], "tokens").alias("ref_common"),
    )


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, the base counts, the two distances (null where a guard holds), base_failed and kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    features = scratch.cut(_text_features(docs, rules), "features")
    refs = scratch.cut(language_references(features), "references")
    known = refs.where("ref_lang is not null")
    if known.count() <= rules.broadcast_rows:
        known = F.broadcast(known)
    whole = refs.where("ref_lang is null").select(F.col("ref_classes").alias("all_classes"))
    joined = features.join(known, features["lang"] == known["ref_lang"], "left").join(F.broadcast(whole), how="left")
    class_distance = F.when(
        F.col("n_chars") >= rules.min_chars,
        js_distance(_closed(F.col("classes"), F.col("n_chars").cast("double")), F.coalesce("ref_classes", "all_classes")),
    )
    common_distance = F.when(
        (F.col("n_words") >= rules.min_common_text_words) & (F.size("common") > 0) & F.col("ref_common").isNotNull(),
        js_distance(_closed(F.col("common"), F.col("n_words").cast("double")), F.col("ref_common")),
    )
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    scored = joined.withColumns({"class_distance": class_distance, "common_distance": common_distance, "base_failed": base})
    fits = F.coalesce(F.col("class_distance") <= rules.max_class_distance, F.lit(True)) & F.coalesce(
        F.col("common_distance") <= rules.max_common_distance, F.lit(True)
    )
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"),
        "base_failed", (~F.col("base_failed") & fits).alias("kept"),
    )
