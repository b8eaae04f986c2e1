"""URL filters: host and path rules, and gradient-boosted trees for what no rule decides. DataFrame functions only.

A rule is a host with a path; it fits its host and all subdomains if the path starts with its own, and the longest
fitting rule wins (of equal lengths the alphabetically first). The trees are trained on labelled URLs; in
``judge`` those are the URLs that a rule decides, at most ``max_examples`` of them (smallest xxhash64 of the key).
They see lexical features only: lengths, depth, digit ratio, character entropy of the host, parameter counts, hyphens,
labels, and two statistics of the host's suffix, kept for every suffix: its share of all URLs, and its smoothed block
rate among the labelled ones. A labelled URL gets the rate of the other folds (of ``folds``, by crc32 of the key), so that
no example sees its answer, and none can be told by what its own label would change. The table of suffixes is broadcast up
to ``broadcast_rows`` rows and joined by a shuffle beyond that.

Training is histogram boosting: features are cut into at most ``bins`` ranges at quantiles of the examples, each level
of a tree is one aggregation of gradients by node, feature and range (at most 2^depth x features x bins rows reach the
driver), and a tree is a nested CASE expression, so that scoring stays in generated code.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by its
features; without labels of both kinds the method gives the one label there is, or allow; repeated rows are judged
alike; a null key stays null; URLs of any length are judged whole; a margin of 0 is allow; an empty table gives an empty
result. Only the key and the url are read.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch, let


@dataclass(frozen=True)
class Boosting:
    trees: int = 8
    depth: int = 3
    bins: int = 16
    rate: float = 0.4
    ridge: float = 1.0
    min_weight: float = 1.0
    max_examples: int = 20_000
    folds: int = 5
    broadcast_rows: int = 100_000


FEATURES = [
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "query_length",
    "n_hyphens", "n_labels", "longest_label", "suffix_share", "suffix_block_rate",
]


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what follows the path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*([\s\S]*)$", 1)


def rule_column(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The winning rule, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    def bits(t: Column) -> Column:
        n = F.length(t)
        distinct = F.array_distinct(F.split(t, ""))
        each = F.transform(F.filter(distinct, lambda c: c != ""), lambda c: n - F.length(F.replace(t, c, F.lit(""))))
        total = F.aggregate(each, F.lit(0.0), lambda a, k: a + k * F.log2(k.cast("double")))
        return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)

    return let(text, bits)


def lexical(pages: DataFrame, key: str) -> DataFrame:
    """key, url, host, path, suffix and the features that one URL gives."""
    host, path, tail = split_url(F.col("url"))
    parts = pages.select(key, "url", host.alias("host"), path.alias("path"), tail.alias("tail"))
    url = F.coalesce("url", F.lit(""))
    labels = F.split("host", r"\.")
    number = lambda c: c.cast("double")
    return parts.select(
        key, "url", "host", "path",
        F.element_at(labels, -1).alias("suffix"),
        number(F.length(url)).alias("url_length"),
        number(F.length("host")).alias("host_length"),
        number(F.length("path")).alias("path_length"),
        number(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]+", "")) / F.greatest(F.length(url), F.lit(1))).alias("digit_ratio"),
        F.round(_entropy(F.col("host")), 6).alias("entropy"),
        number(F.length(F.regexp_replace("tail", "[^=&]+", ""))).alias("n_params"),
        number(F.length("tail")).alias("query_length"),
        number(F.length(F.regexp_replace("host", "[^-]+", ""))).alias("n_hyphens"),
        number(F.size(labels)).alias("n_labels"),
        number(F.array_max(F.transform(labels, F.length))).alias("longest_label"),
    )


def fold_of(key: Column, options: Boosting) -> Column:
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % options.folds).cast("int")


def suffix_statistics(rows: DataFrame, key: str, options: Boosting) -> DataFrame:
    """One row for each suffix: its share of all URLs, how many are blocked and how many labelled in each fold, and the prior
    rate."""
    fold = fold_of(F.col(key), options)
    each = lambda f: F.array(*[f(F.when(fold == i, F.col("label"))) for i in range(options.folds)])
    stats = rows.groupBy("suffix").agg(F.count("*").alias("n"), each(lambda c: F.coalesce(F.sum(c), F.lit(0))).alias("blocked"), each(F.count).alias("known"))
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    total = stats.agg(F.sum("n").alias("all_n"), F.sum(whole("blocked")).alias("all_blocked"), F.sum(whole("known")).alias("all_known"))
    return stats.crossJoin(F.broadcast(total)).select(  # the right side is one row
        F.col("suffix").alias("known_suffix"),
        F.round(F.col("n") / F.col("all_n"), 6).alias("suffix_share"),
        "blocked", "known", whole("blocked").alias("blocked_in_all"), whole("known").alias("known_in_all"),
        ((F.coalesce("all_blocked", F.lit(0)) + 1) / (F.coalesce("all_known", F.lit(0)) + 2)).alias("prior"),
    )


def with_suffix_statistics(rows: DataFrame, known: DataFrame, key: str, options: Boosting) -> DataFrame:
    if known.count() <= options.broadcast_rows:
        known = F.broadcast(known)
    rows = rows.join(known, F.col("suffix") == F.col("known_suffix"), "left")
    fold = fold_of(F.col(key), options)
    own = lambda c: F.when(F.col("label").isNull(), 0).otherwise(F.get(c, fold))
    rate = (F.col("blocked_in_all") - own("blocked") + 10 * F.col("prior")) / (F.col("known_in_all") - own("known") + 10)
    return rows.withColumn("suffix_block_rate", F.round(rate, 6))


class Trees:
    """A sum of trees over feature columns, as one expression."""

    def __init__(self, base: float = 0.0):
        self.base = base
        self.trees: list = []  # nested (feature, threshold, left, right), leaves are numbers

    def column(self) -> Column:
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + _tree_column(tree)
        return out


def _tree_column(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(F.col(feature) <= threshold, _tree_column(left)).otherwise(_tree_column(right))


def train(examples: DataFrame, options: Boosting = Boosting()) -> Trees:
    """``examples`` has the features and label (1: block). It is read trees x depth times, so it should be small."""
    counts = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n0 or not n1:
        return Trees(1.0 if n1 else -1.0)
    cuts = examples.agg(
        *[F.percentile_approx(f, [i / options.bins for i in range(1, options.bins)], 10_000).alias(f) for f in FEATURES]
    ).first()
    edges = {f: sorted(set(cuts[f])) for f in FEATURES}
    bin_of = lambda f: F.aggregate(
        F.array(*[F.lit(float(e)) for e in edges[f]]), F.lit(0), lambda a, e: a + (F.col(f) > e).cast("int")
    )
    # Equal rows of ranges count as one; what is left is the boosting's whole input.
    vectors = examples.select("label", *FEATURES, *[bin_of(f).alias(f"b_{f}") for f in FEATURES])
    vectors = vectors.groupBy("label", *[f"b_{f}" for f in FEATURES]).agg(F.count("*").alias("n")).persist()
    model = Trees(math.log(n1 / n0))
    binned: list = []
    margin: Column = F.lit(model.base)
    try:
        for _ in range(options.trees):
            tree = _grow(vectors, margin, edges, options)
            binned.append(tree)
            margin = margin + _binned_column(tree)
            model.trees.append(_with_thresholds(tree, edges))
    finally:
        vectors.unpersist()
    return model


def _binned_column(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, at, left, right = tree
    return F.when(F.col(f"b_{feature}") <= at, _binned_column(left)).otherwise(_binned_column(right))


def _with_thresholds(tree, edges):
    if isinstance(tree, float):
        return tree
    feature, at, left, right = tree
    return feature, float(edges[feature][at]), _with_thresholds(left, edges), _with_thresholds(right, edges)


def _grow(vectors: DataFrame, margin: Column, edges: dict, options: Boosting):
    """One tree, level by level. A node is named by its path; splits maps a path to (feature, last bin of the left)."""
    p = 1 / (1 + F.exp(-margin))
    base = vectors.withColumns({"g": (p - F.col("label")) * F.col("n"), "h": p * (1 - p) * F.col("n")})
    splits: dict[str, tuple[str, int]] = {}
    leaves: dict[str, float] = {}
    growing = [""]

    def node() -> Column:
        def below(path: str) -> Column:
            if path not in splits:
                return F.lit(path)
            feature, at = splits[path]
            return F.when(F.col(f"b_{feature}") <= at, below(path + "l")).otherwise(below(path + "r"))

        return below("")

    for level in range(options.depth + 1):
        pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES])
        sums = (
            base.select(node().alias("node"), F.explode(pairs).alias("x"), "g", "h")
            .groupBy("node", "x.f", "x.b")
            .agg(F.round(F.sum("g"), 7).alias("g"), F.round(F.sum("h"), 7).alias("h"))
            .collect()
        )
        table: dict[str, dict[str, dict[int, tuple[float, float]]]] = {}
        for r in sums:
            table.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
        following = []
        for path in growing:
            own = table.get(path, {})
            first = own.get(FEATURES[0], {})
            all_g, all_h = (sum(v[i] for v in first.values()) for i in (0, 1))
            leaves[path] = round(-options.rate * all_g / (all_h + options.ridge), 9)
            best = (1e-6, "", 0)
            for f in FEATURES if level < options.depth else []:
                g = h = 0.0
                for b in range(len(edges[f])):
                    g, h = (x + y for x, y in zip((g, h), own.get(f, {}).get(b, (0.0, 0.0))))
                    if h < options.min_weight or all_h - h < options.min_weight:
                        continue
                    score = lambda g, h: g * g / (h + options.ridge)
                    gain = round(score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h), 6)
                    if gain > best[0]:
                        best = (gain, f, b)
            if best[1]:
                splits[path] = best[1:]
                following += [path + "l", path + "r"]
        growing = following
        if not growing:
            break

    def build(path: str):
        if path not in splits:
            return leaves[path]
        return (*splits[path], build(path + "l"), build(path + "r"))

    return build("")


def judge(pages: DataFrame, rules: dict[str, str], key: str = "page_id", options: Boosting = Boosting()) -> DataFrame:
    """key, host, path, rule, verdict and the trees' score. ``rules``: host with path -> block or allow."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = lexical(pages, key)
    rows = rows.withColumn("rule", rule_column(rules, F.col("host"), F.col("path")))
    verdicts = F.create_map(*[F.lit(x) for pair in sorted(rules.items()) for x in pair]) if rules else F.lit(None)
    decided = verdicts[F.col("rule")] if rules else F.lit(None).cast("string")
    rows = rows.withColumn("decided", decided)
    rows = rows.withColumn("label", F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0))
    rows = scratch.cut(rows, "lexical")
    rows = with_suffix_statistics(rows, scratch.cut(suffix_statistics(rows, key, options), "suffixes"), key, options)
    examples = rows.where("label is not null").orderBy(F.xxhash64(key), key).limit(options.max_examples)
    model = train(scratch.cut(examples.select("label", *FEATURES), "examples"), options)
    margin = model.column()
    scored = rows.withColumn("margin", margin)
    return scored.select(
        key, "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"),
        F.round(1 / (1 + F.exp(-F.col("margin"))), 6).alias("score"),
    )
