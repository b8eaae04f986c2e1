"""Packing tokenised documents into windows by the online sum-of-squares rule.

Every document is tokenised and closed with an end id. Whole windows are cut from its front; the rest, shorter than a
window, goes to the open window whose new fill level gives the smallest sum, over the levels 1 to capacity - 1, of
the squared numbers of windows at that level. Only the number of windows at each level decides, so the array of
levels is the whole state, and an item costs one look over it. What is still open when a partition ends is closed by
cutting: those windows' pieces are laid end to end into full windows, so a partition pads at most one window.

Partitions are packed where they lie: no shuffle, one level array each, sequence ids carry the partition in their
upper bits. The rule needs many documents before windows fill by it alone, so partitions are joined until one holds
``min_documents`` of them on average (tables of fewer are one partition); a production partition of 128 MB holds several
times that anyway. A lost partition is packed again in the same way, since its rows come in the same order.

Defined results: a null or empty text is a document of the end id alone; rows that repeat a doc_id are packed each; a
null doc_id stays null; equal choices go to the fullest window; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Memo, batches_of


#: ASCII marks that end a word; an apostrophe or a special token's bars would not be safe to cut off.
TRAILING = ".,;:!?%*$&#"
#: Letters that stay one letter each when they are composed and lower-cased.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Stands between words that are encoded together. It is no white space for the tokenizer.
MARK = "\x1f"


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    end_id: int = 1
    min_documents: int = 8000  # of a partition, on average
    memo_bytes: int = 256 << 20  # of ids of words, in each worker


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit numbers, by a tokenizer whose tokens never cross white space:
    each distinct word is encoded once per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo()
        alone = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = alone[0] if len(alone) == 1 else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        memo = self.memo
        memo.trim()
        missing = [w for w in set().union(*split) if w not in memo]
        if not missing:
            return [b"".join(map(memo.__getitem__, words)) for words in split]
        parts = {w: self._parts(w) for w in missing}
        new = [p for p in {p for own in parts.values() for p in own} if p not in memo]
        long: dict[str, bytes] = {}
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for word, found in zip(some, self._encode_words(some)):
                (memo if len(word) <= 64 else long)[word] = found
                memo.held += 250
        for word, own in parts.items():
            if len(own) == 2 or own[0] != word:
                found = b"".join([memo[p] if len(p) <= 64 else long[p] for p in own])
                (memo if len(word) <= 64 else long)[word] = found
                memo.held += 250
        if not long:
            return [b"".join(map(memo.__getitem__, words)) for words in split]
        return [b"".join([memo[w] if w in memo else long[w] for w in words]) for words in split]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids. Words go in together, with a mark of its own id between them, since a call costs more than
        a word."""
        if self.mark is None or any(MARK in w for w in words):
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        groups = [words[i : i + 400] for i in range(0, len(words), 400)]
        out: list[bytes] = []
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([f" {MARK} ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            assert len(cuts) == len(group) - 1
            out += [part.tobytes() for part in np.split(ids[ids != self.mark], cuts - np.arange(len(cuts)))]
        return out

    @staticmethod
    def _parts(word: str) -> tuple[str, ...]:
        """What the word may be encoded as, one after the other: Latin letters, in lower case if they are ASCII, and the marks
        after them. The tokenizer lower-cases and splits there by itself; this saves most distinct words. Other letters may
        become letters and marks when they are composed or lower-cased, so words with them stay whole."""
        letters = word.rstrip(TRAILING)
        if not LATIN(letters):
            return (word,)
        marks = word[len(letters) :]
        letters = letters.lower() if letters.isascii() else letters
        return (letters, marks) if marks else (letters,)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class SumOfSquares:
    """Open windows by fill level, and where the next item goes."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, dtype=np.int64)  # open windows at each level
        self.open: list[list[int]] = [[] for _ in range(capacity)]

    def choose(self, size: int) -> int:
        """The fill level, 0 for a new window, that the item of this size should join. From level h it moves one
        window to h + size: the sum changes by 2 (N[h + size] - N[h]) + 2, less what does not count at the ends."""
        levels = self.levels
        gain = levels[size:].copy()  # index h: the level that h becomes
        gain *= 2
        gain += 1
        gain[-1] = 0
        gain[1:] -= 2 * levels[1 : self.capacity - size + 1] - 1
        able = levels[: self.capacity - size + 1] > 0
        able[0] = True
        gain[~able] = np.iinfo(np.int64).max
        least = gain.min()
        return int(len(gain) - 1 - np.argmax(gain[::-1] == least))  # the fullest of equals

    def place(self, size: int, fresh) -> tuple[int, int]:
        """(window, offset) for an item; fresh() names a new window."""
        level = self.choose(size)
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
        else:
            window = fresh()
        if level + size < self.capacity:
            self.open[level + size].append(window)
            self.levels[level + size] += 1
        return window, level


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, options: Packing = Packing(), carry_ids: bool = False) -> DataFrame:
    """One row per piece. With ``carry_ids`` also its ids, little-endian unsigned 32-bit."""
    capacity = options.capacity
    end = np.array([options.end_id], dtype="<u4").tobytes()
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["ids"] * carry_ids

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names
        )

    def run(batches):
        model, state = tokenizer(path), SumOfSquares(capacity)
        model.memo.limit = options.memo_bytes
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        made = 0
        inside: dict[int, list[tuple]] = {}  # pieces of open windows; windows are forgotten once full

        def fresh() -> int:
            nonlocal made
            made += 1
            return first + made - 1

        def row(doc, start, ids, total, window, offset):
            return (doc, start, len(ids) // 4, zlib.crc32(ids), total, window, offset, *([ids] if carry_ids else []))

        for rows in batches_of(batches, ["doc_id", "text"], 4 << 20, model.memo):
            out = []
            for (doc, _), ids in zip(rows, model.encode([r[1] for r in rows])):
                ids += end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    out.append(row(doc, start, ids[4 * start : 4 * (start + capacity)], total, fresh(), 0))
                if whole < total:
                    size = total - whole
                    window, offset = state.place(size, fresh)
                    held = inside.setdefault(window, [])
                    held.append((doc, whole, ids[4 * whole :], total, offset))
                    if offset + size == capacity:
                        out += [row(d, s, i, t, window, o) for d, s, i, t, o in inside.pop(window)]
            yield table(out)
        # Close what is open: end to end, cut at each full window.
        out, offset, window = [], capacity, -1
        for key in sorted(inside):
            for doc, start, ids, total, _ in inside[key]:
                while ids:
                    if offset == capacity:
                        window, offset = fresh(), 0
                    part, ids = ids[: 4 * (capacity - offset)], ids[4 * (capacity - offset) :]
                    out.append(row(doc, start, part, total, window, offset))
                    start, offset = start + len(part) // 4, offset + len(part) // 4
        yield table(out)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.coalesce(max(1, docs.count() // options.min_documents))
    return docs.mapInArrow(run, COLUMNS + (", ids binary" if carry_ids else ""))
