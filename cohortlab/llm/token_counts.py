"""Counting tokens of a unigram model without building them.

An Aho-Corasick automaton over the vocabulary yields every piece that ends at a position; a dynamic programme over
the positions carries the best score, the number of pieces on that path and whether its last piece was unknown. The
tie rules are those of the ``tokenizers`` library: of equal scores the piece that starts first (the longest) stays;
a character that no one-character piece covers may be unknown, at the lowest score less 10; neighbouring unknowns
are one token.

Text falls into words at blanks, as the library's Metaspace rule does it, and each distinct word is counted once per
worker (a memo of bounded size), so the automaton sees the vocabulary of the corpus and not its volume.

Defined results: a null or empty text has no tokens and score 0; a word of any length is handled in one pass; rows that
repeat a doc_id, or have none, are counted each; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Memo, batches_of
from cohortlab.llm.piece_encoding import MARK, NORMAL, Model

UNKNOWN_PENALTY = 10.0


def vocabulary(path: str, shift: float = 10.0) -> list[tuple[str, float]]:
    """Pieces of a public model with Zipf log probabilities by rank: -ln(rank + shift), less their total. The file
    is a merge model whose own scores are only ranks, so they are turned into probabilities this way."""
    with open(path, "rb") as f:
        model = Model.read(f.read())
    ranked = sorted((i for i, k in enumerate(model.kinds) if k == NORMAL), key=lambda i: (-model.scores[i], i))
    total = math.log(sum(1 / (r + shift) for r in range(len(ranked))))
    return [(model.pieces[i], -math.log(r + shift) - total) for r, i in enumerate(ranked)]


class Counter:
    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self.memo = Memo()

    def word(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of the best segmentation of one word."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count, loose = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        for end in range(1, n + 1):
            top, at, unknown, single = None, end - 1, False, False
            for size, score in sorted(ends[end - 1], reverse=True):
                candidate = score + best[end - size]
                single = single or size == 1
                if top is None or candidate > top:
                    top, at = candidate, end - size
            if not single:
                candidate = self.unknown + best[end - 1]
                if top is None or candidate > top:
                    top, at, unknown = candidate, end - 1, True
            best[end], loose[end] = top, unknown
            count[end] = count[at] + (0 if unknown and loose[at] else 1)
        return count[n], best[n] or 0.0

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = text.replace(MARK, " ").split(" ")
        if not parts[0]:
            parts = parts[1:]
        memo, tokens, score = self.memo, 0, 0.0
        memo.trim()
        for p in parts:
            found = memo.get(p)
            if found is None:
                found = self.word(MARK + p)
                memo.keep(p, found, 100)
            tokens += found[0]
            score += found[1]
        return tokens, score


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score: the score is the log probability of the best segmentation."""

    def run(batches):
        model = counter(path)
        for rows in batches_of(batches, ["doc_id", "text"], memo=model.memo):
            found = [model.text(r[1]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "n_tokens", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
