"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: from labelled documents (at most ``max_documents``, those with the smallest xxhash64 of doc_id, which bounds
the model too) the log-odds
of every feature between toxic and other documents, each smoothed by a Dirichlet prior proportional to the feature's
share in both together; features whose z-score is below ``min_z`` are left out. A feature is a lower-case word without
the marks around it, or, for words the model does not know, a word's first letters. Every token also pays ``drift``, so
that a neutral text scores downwards.

Scoring: one linear scan finds all maximal segments (Ruzzo and Tompa's algorithm over runs of one sign). Their scores
are calibrated by extreme-value theory: lambda solves the moment equation of the token scores of documents that are
not toxic, K follows from those documents' best segments, and a segment of score S in n tokens is significant if
K n exp(-lambda S) is below ``max_expected``. A document's evidence is the sum of lambda S - ln(K n) over its significant
segments, plus what its best segment falls short of significance; a logistic curve over the evidence and its share
per token, fitted on the labelled documents, makes the score.

Defined results: a null, empty or wordless text has evidence 0, no segments, and the score that belongs to it; without
labels of both kinds every score is the share of toxic labels, or 0; repeated labels of a document count once, toxic
if any of them says so; null labels are ignored. Rows that repeat a doc_id are scored each, and the smallest of their
texts is learned from. A score equal to the threshold is toxic. Empty tables give empty results; ``score`` reads
doc_id and text only, ``without_toxic`` returns the columns it was given, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Memo, Scratch, batches_of, fold, slices_of

MARKS = ".,;:!?\"'()[]{}*$%&#|<>-"


@dataclass(frozen=True)
class Toxicity:
    max_documents: int = 20_000
    min_count: int = 5
    min_documents: int = 3
    min_z: float = 3.0
    prior: float = 0.02  # of the tokens of both
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)
    drift: float = 0.05
    max_expected: float = 1.0
    threshold: float = 0.3
    held_out_fold: int = 2


class Scores(Memo):
    """Scores of the tokens seen so far."""

    model: Model

    def __missing__(self, token: str) -> float:
        score = self.model.token(token)
        self.keep(token, score, 24)
        return score


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.08
    prefixes: tuple[int, ...] = ()
    lam: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, ...] = (-40.0, 0.0, 0.0)
    max_expected: float = 1.0
    memo: Scores = field(default_factory=lambda: Scores(48 << 20))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": Scores(48 << 20)}

    def token(self, word: str) -> float:
        word = word.strip(MARKS)
        found = self.weights.get(word)
        if found is None:
            found = 0.0
            for n in self.prefixes:
                if len(word) >= n:
                    found = self.weights.get("^" + word[:n], found)
        return found

    def scores(self, tokens: list[str]) -> np.ndarray:
        self.memo.trim()
        self.memo.model = self
        return np.fromiter(map(self.memo.__getitem__, tokens), np.float64, len(tokens)) - self.drift

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """(start, end, score) of every significant maximal segment."""
        n = max(1, len(scores))
        floor = (self.log_k + math.log(n) - math.log(self.max_expected)) / self.lam
        return [s for s in maximal_segments(scores) if s[2] > floor]

    def evidence(self, scores: np.ndarray) -> tuple[float, float]:
        """Sum over the significant segments, and the same by token; the best segment counts even if below."""
        if not len(scores):
            return 0.0, 0.0
        level = self.log_k + math.log(len(scores))
        found = [self.lam * s - level for _, _, s in maximal_segments(scores)]
        floor = -math.log(self.max_expected)
        total = sum(x for x in found if x > floor) or min(0.0, max(found, default=0.0))
        return total, total / len(scores)

    def probability(self, total: float, share: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * signed_root(total) + c * signed_root(share)))))


def signed_root(x: float) -> float:
    return math.copysign(math.sqrt(abs(x)), x)


def tokens_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments in linear time. Neighbouring scores of one sign are taken as one."""
    n = len(scores)
    if not n:
        return []
    positive = scores > 0
    cuts = np.flatnonzero(np.diff(positive)) + 1
    starts = np.r_[0, cuts]
    ends = np.r_[cuts, n]
    sums = np.r_[0.0, np.cumsum(scores)]
    out: list[list] = []  # [start, end, sum before, sum after, index of the nearest with a smaller sum before]
    for start, end, up in zip(starts.tolist(), ends.tolist(), positive[starts].tolist()):
        if not up:
            continue
        new = [start, end, sums[start], sums[end], -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            new[4] = j
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]
            del out[j:]
    return [(s[0], s[1], float(s[3] - s[2])) for s in out]


def labelled(docs: DataFrame, labels: DataFrame, options: Toxicity) -> DataFrame:
    """text and toxic of the labelled documents to learn from, at most max_documents rows; as many ids are broadcast."""
    marks = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != options.held_out_fold))
    marks = marks.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    here = docs.select("doc_id").where("doc_id is not null")
    chosen = (
        marks.join(here, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(options.max_documents)
        .select(F.col("doc_id").alias("marked"), "toxic")
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("marked"))
    return rows.groupBy("marked", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, options: Toxicity = Toxicity()) -> Model:
    sample = Scratch(docs.sparkSession, "toxicity").cut(labelled(docs, labels, options), "sample")
    prefixes = options.prefixes

    def count(batches):
        for rows in batches_of(batches, ["text", "toxic"], 1 << 20):
            found: dict[str, list[int]] = {}
            for text, toxic in rows:
                seen = set()
                for word in tokens_of(text):
                    word = word.strip(MARKS)
                    if not word:
                        continue
                    for feature in (word, *("^" + word[:n] for n in prefixes if len(word) >= n)):
                        own = found.setdefault(feature, [0, 0, 0, 0])
                        own[toxic] += 1
                        if feature not in seen:
                            seen.add(feature)
                            own[2 + toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), *(pa.array([v[i] for v in found.values()], pa.int64()) for i in range(4))],
                names=["feature", "n0", "n1", "d0", "d1"],
            )

    kind = "feature string, n0 long, n1 long, d0 long, d1 long"
    counts = sample.mapInArrow(count, kind).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")])
    counts = counts.persist()
    try:
        total = counts.where(~F.col("feature").startswith("^")).agg(F.sum("n0"), F.sum("n1")).first()
        all0, all1 = total[0] or 0, total[1] or 0
        if not all0 or not all1:
            share = sample.agg(F.avg("toxic")).first()[0] or 0.0
            odds = 40.0 if share >= 1 else -40.0 if share <= 0 else math.log(share / (1 - share))
            return Model(drift=options.drift, curve=(odds, 0.0, 0.0))
        prior = options.prior * (F.col("n0") + F.col("n1"))
        mass = options.prior * (all0 + all1)
        odds = lambda n, total: F.log((n + prior) / (total + mass - n - prior))
        weight = odds(F.col("n1"), all1) - odds(F.col("n0"), all0)
        spread = F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
        kept = (
            counts.where((F.col("n0") + F.col("n1") >= options.min_count) & (F.col("d0") + F.col("d1") >= options.min_documents))
            .select("feature", F.round(weight, 6).alias("w"), (weight / spread).alias("z"))
            .where(F.abs("z") >= options.min_z)
        )
        weights = {r["feature"]: r["w"] for r in kept.collect()}
    finally:
        counts.unpersist()
    model = Model(weights, options.drift, prefixes, max_expected=options.max_expected)
    return _calibrate(model, sample)


def _calibrate(model: Model, sample: DataFrame) -> Model:
    bins, low = 800, -8.0  # of token scores, a fiftieth each

    def stats(batches):
        """Per document: label, tokens, best segment; per batch: the histogram of non-toxic token scores."""
        for rows in batches_of(batches, ["text", "toxic"], memo=model.memo):
            histogram, out = np.zeros(bins, np.int64), []
            for text, toxic in rows:
                scores = model.scores(tokens_of(text))
                if not toxic:
                    at = np.clip(((scores - low) * 50).round().astype(int), 0, bins - 1)
                    histogram += np.bincount(at, minlength=bins)
                best = max((s for _, _, s in maximal_segments(scores)), default=0.0)
                out.append((toxic, len(scores), best))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out] + [None], pa.int32()), pa.array([x[1] for x in out] + [None], pa.int64()),
                 pa.array([x[2] for x in out] + [None], pa.float64()), pa.array([None] * len(out) + [histogram.tolist()], pa.list_(pa.int64()))],
                names=["toxic", "n", "best", "histogram"],
            )

    rows = sample.mapInArrow(stats, "toxic int, n long, best double, histogram array<long>").collect()
    histogram = np.sum([r["histogram"] for r in rows if r["histogram"]], axis=0)
    clean = sorted((r["n"], r["best"]) for r in rows if r["toxic"] == 0 and r["n"])
    model.lam = karlin_lambda(low + np.arange(bins) / 50, histogram)
    if clean:
        n, best = np.array([x[0] for x in clean], float), np.array([x[1] for x in clean])
        # The mean of the extreme-value law: lambda E(best) = ln(K n) + Euler's constant.
        model.log_k = float(np.mean(model.lam * best - np.log(n)) - 0.5772156649015329)

    def evidence(batches):
        for rows in batches_of(batches, ["text", "toxic"], memo=model.memo):
            found = [model.evidence(model.scores(tokens_of(t))) for t, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int32()), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64())],
                names=["toxic", "total", "share"],
            )

    points = sorted(tuple(r) for r in sample.mapInArrow(evidence, "toxic int, total double, share double").collect())
    model.curve = logistic_curve(points)
    return model


def karlin_lambda(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 1 where there is none."""
    p = counts / max(1, counts.sum())
    if not (p[values > 0].sum() > 0 and (p * values).sum() < 0):
        return 1.0
    low, high = 1e-6, 1.0
    moment = lambda x: float((p * np.exp(np.clip(x * values, -700, 700))).sum())
    while moment(high) < 1 and high < 64:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    return (low + high) / 2


def logistic_curve(points: list[tuple[int, float, float]]) -> tuple[float, float, float]:
    """Newton's method with a small ridge, on the signed roots of both."""
    y = np.array([p[0] for p in points], float)
    x = np.array([[1.0, signed_root(p[1]), signed_root(p[2])] for p in points])
    beta = np.zeros(3)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x + ridge, x.T @ (y - mu) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(round(b, 9)) for b in beta)


def score(docs: DataFrame, model: Model, options: Toxicity = Toxicity(), with_segments: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments; with_segments adds their token spans and scores."""
    names = ["doc_id", "held_out", "score", "predicted", "n_segments"] + ["segments"] * with_segments

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for rows in batches_of(batches, ["doc_id", "held_out", "text"], memo=model.memo):
            values, spans = [], []
            for _, _, text in rows:
                scores = model.scores(tokens_of(text))
                spans.append([{"start": a, "end": b, "score": s} for a, b, s in model.segments(scores)])
                values.append(model.probability(*model.evidence(scores)))
            columns = [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array(values, pa.float64()),
                pa.array([int(v >= options.threshold) for v in values], pa.int32()), pa.array(list(map(len, spans)), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(spans, kind)] * with_segments, names=names)

    held_out = F.coalesce(fold(F.col("doc_id")) == options.held_out_fold, F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, score double, predicted int, n_segments long"
    schema += ", segments array<struct<start:long,end:long,score:double>>" if with_segments else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text").mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows, all columns, whose text scores below the threshold."""

    def run(batches):
        for batch in slices_of(batches, "text", memo=model.memo):
            texts = batch.column("text").to_pylist()
            below = [model.probability(*model.evidence(model.scores(tokens_of(t)))) < threshold for t in texts]
            yield batch.filter(pa.array(below, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
