"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is a language's most frequent letter n-grams of 1 to 3 characters, in order of frequency; words are
padded with a blank on either side and n-grams never span two words. A document's own most frequent n-grams are
ranked the same way, and its distance to a language sums how far each is out of place there (an n-gram that the
profile lacks counts as ``size`` places). Equal counts are ranked by the n-gram's code points, and equal distances
go to the alphabetically first language, so results do not depend on partitioning.

Profiles are fitted on at most ``docs_per_language`` documents of each language, those with the smallest xxhash64 of
doc_id; of a language with many, only those whose hash lies in a range that holds about twice as many are looked at, so
that no task sorts a language. Every document is scored on its whole text.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is every text if nothing could be
learned; a null doc_id is neither held out nor learned from; repeated rows are scored alike, and the smallest text of a
doc_id is learned from; empty tables give empty results. ``identify`` reads doc_id and text only, ``in_known_language``
returns the columns it was given, whatever their names.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch, batches_of, fold, slices_of

BITS = 21  # a code point


@dataclass(frozen=True)
class LanguageId:
    size: int = 400
    docs_per_language: int = 1000
    held_out_fold: int = 2
    broadcast_ids: int = 1_000_000  # a list of ids is broadcast up to this size, and joined by a shuffle beyond it


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    table[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = True
    return table


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed 21 bits a character, and their counts."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = np.where(_letters()[codes], codes, 32)
    blank = codes == 32
    codes = codes[~(blank & np.r_[False, blank[:-1]])]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one = codes[codes != 32]
    two = codes[:-1] | (codes[1:] << BITS)
    middle = codes[1:-1] != 32
    three = (two[:-1] | (codes[2:] << 2 * BITS))[middle]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, in order."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


def learn(docs: DataFrame, options: LanguageId = LanguageId()) -> dict[str, list[int]]:
    """Language -> packed n-grams in order. ``size`` numbers for each language reach the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != options.held_out_fold))
    rows = rows.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5  # evenly from 0 to 1
    near = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), place.alias("p"))
    # One row for each language, less than the profiles that the driver and every task hold.
    near = near.join(F.broadcast(sizes), "lang").where(F.col("p") * F.col("n") <= 2 * options.docs_per_language)
    chosen = near.select("lang", "doc_id", "h").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= options.docs_per_language)
    scratch = Scratch(docs.sparkSession, "languages")
    chosen = scratch.cut(chosen.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_doc")), "chosen")
    if chosen.count() <= options.broadcast_ids:
        chosen = F.broadcast(chosen)
    sample = rows.join(chosen, (F.col("doc_id") == F.col("_doc")) & (F.col("lang") == F.col("_lang"))).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    sample = scratch.cut(sample.select("lang", "text"), "sample")

    def count(batches):
        for batch in slices_of(batches, "text"):
            totals: dict[str, dict[int, int]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = totals.setdefault(lang, {})
                for key, n in zip(*map(np.ndarray.tolist, ngrams(text))):
                    own[key] = own.get(key, 0) + n
            flat = [(lang, key, n) for lang, own in totals.items() for key, n in own.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())],
                names=["lang", "gram", "n"],
            )

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= options.size)
    profiles: dict[str, list[int]] = {}
    for row in sorted(top.collect(), key=lambda r: (r["lang"], r["k"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size = size
        self.languages = sorted(profiles)
        self.keys = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
        self.place = np.full((len(self.languages), len(self.keys)), -1, dtype=np.int64)
        for i, lang in enumerate(self.languages):
            grams = np.array(profiles[lang], dtype=np.int64)
            self.place[i, np.searchsorted(self.keys, grams)] = np.arange(len(grams))

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language and, as score, the share of the largest possible distance that was not needed."""
        if not text or not self.languages:
            return "und", 0.0
        own = ranked(*ngrams(text), self.size)
        if not len(own):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        place = np.where(self.keys[at] == own, self.place[:, at], -1)
        out = np.where(place >= 0, np.abs(place - np.arange(len(own))), self.size).sum(axis=1)
        best = int(out.argmin())
        return self.languages[best], float(1 - out[best] / (self.size * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], options: LanguageId = LanguageId()) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def predict(batches):
        model = Classifier(profiles, options.size)
        for rows in batches_of(batches, ["doc_id", "held_out", "text"]):
            found = [model.classify(r[2]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
                 pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    held_out = F.coalesce(fold(F.col("doc_id")) == options.held_out_fold, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text").mapInArrow(
        predict, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def in_known_language(docs: DataFrame, profiles: dict[str, list[int]], least_score: float, options: LanguageId = LanguageId()) -> DataFrame:
    """The rows, all columns, whose text has a language with at least this score."""

    def run(batches):
        model = Classifier(profiles, options.size)
        for batch in slices_of(batches, "text"):
            found = [model.classify(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
