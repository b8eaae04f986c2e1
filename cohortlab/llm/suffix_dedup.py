"""Removing passages that a document with a smaller id has too: exact, byte by byte, by run-length suffix indexes.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller doc_id. First, exact
copies are set aside by a 128-bit fingerprint: all but the one with the smallest id go as a whole. Three steps follow:

1. Anchors. Of the k-byte strings in a window of ``length`` bytes the one with the least hash (leftmost of equals) is
   its anchor, so equal windows have equal anchors wherever they are. Neighbouring windows mostly share theirs: about
   one anchor for every 16 bytes. A window reaches beyond its anchor by half of the rest at least, to the left or to the
   right; so anchors are exchanged with the hashes of both such extensions, packed, and one that shares neither
   with another document is dropped.
2. Contexts. Around each remaining anchor the text that its windows cover (at most 2 length - k bytes) is taken out;
   equal contexts are one, with the smallest doc_id that has it. Contexts with one anchor hash meet in one task.
3. Index. A task builds the Burrows-Wheeler transform of its contexts in bounded chunks, run-compressed, with the
   rows at run ends sampled: a context's step from a suffix to the one before it needs its run only. Every
   context is streamed backwards through the runs; at each position the row it stands on tells the range of rows that
   match it for ``length`` bytes or more, and the smallest doc_id in that range, its matching statistic. The
   windows whose smallest doc_id is below a document's own are marked, and merged into spans.

A passage that a third of all documents hold is a frequent context: its rows are reduced to one per task before the
exchange, and the answer is joined back to (document, position) rows, a join that adaptive execution splits.

Defined results: a null text is the empty one; a null doc_id neither loses bytes nor counts as smaller; rows with
one doc_id are one document and do not remove each other, each loses what its own text shares with smaller ids;
texts shorter than ``length`` bytes stay whole; an empty table gives an empty result. Only doc_id and text are read;
``without_repeats`` also counts n_chars anew, and gives back all other columns as they are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch, batches_of, partition_names, restrict, slices_of
from cohortlab.llm.jaccard_join import mixed

PRIME = 0x100000001B3


@dataclass(frozen=True)
class SuffixDedup:
    length: int = 50
    anchor: int = 20
    batch_bytes: int = 1 << 20
    chunk_bytes: int = 1 << 19
    broadcast_ids: int = 1_000_000  # a list of ids is broadcast up to this size, and joined by a shuffle beyond it


class Grams:
    """Hashes of all strings of a given size, from those of powers of two."""

    def __init__(self, data: np.ndarray):
        self.known = {1: mixed(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))}

    def of(self, size: int) -> np.ndarray:
        length = 1
        while 2 * length <= size:
            half = self.known[length]
            if 2 * length not in self.known:
                self.known[2 * length] = self._joined(half, length, half, length)
            length *= 2
        out, have = self.known[length], length
        for part in sorted(self.known, reverse=True):
            if have + part <= size:
                out, have = self._joined(out, have, self.known[part], part), have + part
        return mixed(out)

    @staticmethod
    def _joined(left: np.ndarray, size: int, right: np.ndarray, more: int) -> np.ndarray:
        tail = right[size:]
        return left[: len(tail)] * np.uint64(pow(PRIME, more, 1 << 64)) + tail


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Runs:
    """Runs of windows with one anchor: document, first and last window start, anchor hash, and the hashes (0 where the
    document ends before) of the anchor with what is to its left and right. Positions count from the document's first
    byte; ``base`` is where that lies in ``data``."""

    data: bytes
    doc: np.ndarray
    base: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray
    left: np.ndarray
    right: np.ndarray


def window_runs(texts: list[bytes], options: SuffixDedup) -> Runs:
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    none = np.empty(0, np.int64)
    nothing = Runs(data, none, none, none, none, *[none.astype(np.uint32)] * 3)
    if len(data) < options.length:
        return nothing
    make = Grams(np.frombuffer(data, np.uint8))
    grams = make.of(options.anchor)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_least(keys, options.length - options.anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.flatnonzero(owner[: len(at)] == owner[options.length - 1 :])  # windows inside one document
    if not len(starts):
        return nothing
    anchors = at[starts]
    change = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
    head, tail = np.r_[0, change], np.r_[change, len(anchors)] - 1
    doc, anchors = owner[starts[head]], anchors[head]
    beyond = (options.length - options.anchor) // 2
    wide = make.of(options.anchor + beyond)

    def extended(first: np.ndarray) -> np.ndarray:
        inside = (first >= begins[doc]) & (first + options.anchor + beyond <= begins[doc] + sizes[doc])
        return np.where(inside, wide[np.clip(first, 0, len(wide) - 1)] | np.uint64(1), np.uint64(0)).astype(np.uint32)

    return Runs(data, doc, begins[doc], starts[head] - begins[doc], starts[tail] - begins[doc], grams[anchors].astype(np.uint32), extended(anchors - beyond), extended(anchors))


# Step 1 ------------------------------------------------------------------------------------------------------


def _unpack(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, rows of ``width`` numbers): of each blob the number of documents, their ids, their rows' numbers, the rows."""
    docs, rows = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        docs.append(np.repeat(np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, "<u4", n, 4 + 8 * n)))
        rows.append(np.frombuffer(blob, "<u4", -1, 4 + 12 * n).reshape(width, -1).T)
    return np.concatenate(docs), np.concatenate(rows)


def _pack(docs: np.ndarray, rows: np.ndarray) -> bytes:
    """The inverse; docs must be grouped. Rows are written column by column."""
    cuts = np.r_[0, np.flatnonzero(docs[1:] != docs[:-1]) + 1, len(docs)]
    counts = np.diff(cuts).astype("<u4")
    return len(counts).to_bytes(4, "little") + docs[cuts[:-1]].astype("<i8").tobytes() + counts.tobytes() + rows.T.astype("<u4").tobytes()


def _by_bucket(kind: str, bucket: np.ndarray, docs: np.ndarray, rows: np.ndarray) -> list[tuple[int, str, bytes]]:
    """(bucket, kind, blob) of every bucket's rows."""
    order = np.lexsort((docs, bucket))
    bucket, docs, rows = bucket[order], docs[order], rows[order]
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    return [(int(bucket[a]), kind, _pack(docs[a:b], rows[a:b])) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def _several(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a row's key is in more than one document."""
    if not len(keys):
        return np.empty(0, bool)
    order = np.lexsort((docs, keys))
    sorted_keys, sorted_docs = keys[order], docs[order]
    cuts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    many = sorted_docs[cuts] != sorted_docs[np.r_[cuts[1:], len(keys)] - 1]
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(many, np.diff(np.r_[cuts, len(keys)]))
    return out


def _sided(rows: np.ndarray, side: int) -> np.ndarray:
    """Anchor and extension as one number."""
    return (rows[:, 0].astype(np.uint64) << np.uint64(32)) | rows[:, side]


def shared_anchors(docs: DataFrame, options: SuffixDedup) -> DataFrame:
    """doc, anchors: the hashes of a document's anchors that, with an extension, other documents have too, packed.

    What several documents of one batch share is decided there: their task gets one row for all of them, so a passage that
    a third of all documents hold sends no more than a row or two of each batch to the task of its anchor."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = partition_names(parts)
    # Kinds of blobs: t, anchors to compare; s, extended anchors that a batch found to be shared; m, shared anchors of documents.
    schema = "bucket int, kind string, anchors binary"

    def spread(values: np.ndarray) -> np.ndarray:
        return names[(mixed(values.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)]

    def batch(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "kind", "anchors"])

    def blobs(batches) -> dict[str, list[bytes]]:
        found: dict[str, list[bytes]] = {"t": [], "s": [], "m": []}
        for b in batches:
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("anchors").to_pylist()):
                found[kind].append(blob)
        return found

    def distinct(ids: np.ndarray, hashes: np.ndarray) -> list[tuple[int, str, bytes]]:
        order = np.lexsort((hashes, ids))
        ids, hashes = ids[order], hashes[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])][: len(ids)]
        return _by_bucket("m", spread(ids[new]), ids[new], hashes[new][:, None])

    def give(batches):
        for rows in batches_of(batches, ["doc", "text"], options.batch_bytes):
            runs = window_runs([r[1].encode() for r in rows], options)
            ids = np.array([r[0] for r in rows], np.int64)[runs.doc]
            anchors = np.stack([runs.hash, runs.left, runs.right], axis=1)
            here, out = np.zeros(len(ids), bool), []
            for side in (1, 2):
                some = np.flatnonzero(anchors[:, side])
                keys = _sided(anchors[some], side)
                shared = _several(keys, ids[some])
                here[some[shared]] = True
                told = np.unique(keys[shared])
                if len(told):
                    pair = np.stack([told >> np.uint64(32), told & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
                    out += _by_bucket("s", spread(pair[:, 0]), np.full(len(pair), side, np.int64), pair)
            out += distinct(ids[here], anchors[here, 0]) if here.any() else []
            # An anchor that is decided by one side may still be what another document lacks on the other.
            ask = ~here
            for side in (1, 2):
                some = np.flatnonzero(here & (anchors[:, side] > 0))
                ask[some[~_several(_sided(anchors[some], side), ids[some])]] = True
            out += _by_bucket("t", spread(anchors[ask, 0]), ids[ask], anchors[ask]) if ask.any() else []
            if out:
                yield batch(out)

    def meet(batches):
        found = blobs(batches)
        for a in range(0, len(found["m"]), 1000):  # on their way to the documents' tasks
            part = found["m"][a : a + 1000]
            first = np.array([int.from_bytes(b[4:12], "little", signed=True) for b in part])
            yield batch(list(zip(spread(first).tolist(), ["m"] * len(part), part)))
        if not found["t"]:
            return
        ids, rows = _unpack(found["t"], 3)
        sides, told = _unpack(found["s"], 2) if found["s"] else (np.empty(0, np.int64), np.empty((0, 2), np.uint32))
        keep = np.zeros(len(ids), bool)
        for side in (1, 2):
            some = np.flatnonzero(rows[:, side])
            keys = _sided(rows[some], side)
            keep[some] |= _several(keys, ids[some]) | np.isin(keys, _sided(told[sides == side], 1))
        if keep.any():
            yield batch(distinct(ids[keep], rows[keep, 0]))

    def gather(batches):
        found = blobs(batches)["m"]
        if not found:
            return
        ids, hashes = _unpack(found, 1)
        order = np.argsort(ids, kind="stable")
        ids, hashes = ids[order], np.ascontiguousarray(hashes[order, 0])
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        for at in range(0, len(cuts), 4096):
            some = cuts[at : at + 4096]
            ends = np.r_[cuts[at + 1 : at + 1 + len(some)], len(ids)][: len(some)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some], pa.int64()), pa.array([hashes[a:b].tobytes() for a, b in zip(some, ends)], pa.binary())],
                names=["doc", "anchors"],
            )

    met = docs.mapInArrow(give, schema).repartition(parts, "bucket").mapInArrow(meet, schema)
    return met.repartition(parts, "bucket").mapInArrow(gather, "doc long, anchors binary")


def marks_of(docs: DataFrame) -> DataFrame:
    """doc, size and a 128-bit fingerprint of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc", F.octet_length(text).alias("size"), F.xxhash64(text).alias("f1"), F.xxhash64(F.lit(1), text).alias("f2"))


def with_twins(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``twin``: 0, but for documents with several texts the number of the text."""
    again = marks.where("doc is not null").groupBy("doc").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low <> high").select("doc")
    if again.isEmpty():
        return docs.withColumn("twin", F.lit(0)), marks.withColumn("twin", F.lit(0))
    number = F.row_number().over(Window.partitionBy("_doc").orderBy("_f")) - 1
    texts = marks.join(again, "doc").select(F.col("doc").alias("_doc"), F.col("f1").alias("_f")).distinct().withColumn("_twin", number)
    add = lambda df, f: df.join(texts, (df["doc"] == F.col("_doc")) & (f == F.col("_f")), "left").withColumn("twin", F.coalesce("_twin", F.lit(0))).drop("_doc", "_f", "_twin")
    return add(docs, F.xxhash64(F.coalesce("text", F.lit("")))), add(marks, F.col("f1"))


def copies(marks: DataFrame, options: SuffixDedup) -> DataFrame:
    """doc, twin, size: texts that a document with a smaller id has as a whole."""
    rows = marks.where(f"doc is not null and size >= {options.length}")
    first = rows.groupBy("f1", "f2", "size").agg(F.min("doc").alias("first"), F.count("*").alias("k")).where("k > 1")
    return rows.join(first.select("f1", "f2", "size", "first"), ["f1", "f2", "size"]).where("doc > first").select("doc", "twin", "size").distinct()


# Step 2 ------------------------------------------------------------------------------------------------------


def contexts(docs: DataFrame, shared: DataFrame, options: SuffixDedup) -> DataFrame:
    """context, hash, doc, twin, first: a row for every run of windows whose anchor is shared."""

    def run(batches):
        for rows in batches_of(batches, ["doc", "text", "anchors", "twin"], options.batch_bytes):
            runs = window_runs([r[1].encode() for r in rows], options)
            keep = np.zeros(len(runs.doc), bool)
            cuts = np.searchsorted(runs.doc, np.arange(len(rows) + 1))
            for i, row in enumerate(rows):
                a, b = cuts[i], cuts[i + 1]
                keep[a:b] = np.isin(runs.hash[a:b], np.frombuffer(row[2], "<u4"))
            at = np.flatnonzero(keep)
            begin = runs.base[at] + runs.first[at]
            end = runs.base[at] + runs.last[at] + options.length
            ids, twins = (np.array([r[i] for r in rows], t)[runs.doc[at]] for i, t in ((0, np.int64), (3, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([runs.data[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary()),
                 pa.array(runs.hash[at].astype(np.int64)), pa.array(ids), pa.array(twins), pa.array(runs.first[at].astype(np.int32))],
                names=["context", "hash", "doc", "twin", "first"],
            )

    found = docs.join(shared, "doc").select("doc", "text", "anchors", "twin")
    return found.mapInArrow(run, "context binary, hash long, doc long, twin int, first int")


# Step 3 ------------------------------------------------------------------------------------------------------


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of texts, each closed by byte 0, which no text may hold otherwise. The
    suffix order is needed to build it and not kept.

    ``starts``: first row of each run; ``jump``: the row that the run's first row steps back to, the sample at the run's
    end from which all its rows follow. ``blocks``: first rows of the ranges that share ``length`` bytes, and ``least``
    the smallest value of ``low``, one for each text, in each; all grow with what is new in the texts, not with their
    size. ``closing``: the row of each text's end, where its stream begins."""

    def __init__(self, texts: list[bytes], low: np.ndarray, length: int):
        self.length = length
        self.sizes = np.array([len(t) for t in texts], np.int64)
        joined = b"\0".join(texts) + b"\0"
        data = np.frombuffer(joined, np.uint8)
        n = len(data)
        # Order of all suffixes: by 8 bytes, then by twice as many, until all differ.
        padded = np.frombuffer(joined + b"\0" * 8, np.uint8).astype(np.uint64)
        pairs = (padded[:-1] << np.uint64(8)) | padded[1:]
        fours = (pairs[:-2] << np.uint64(16)) | pairs[2:]
        key = (fours[:n] << np.uint64(32)) | fours[4 : n + 4]
        order = np.argsort(key)
        rank = self._ranks(key[order], order)
        span, prefix = 8, {8: rank}
        while rank.max(initial=0) + 1 < n or span < length:
            far = np.full(n, 0, np.int64)
            far[: max(0, n - span)] = rank[span:] + 1
            key = (rank.astype(np.uint64) << np.uint64(32)) | far.astype(np.uint64)
            order = np.argsort(key)
            rank = self._ranks(key[order], order)
            span *= 2
            if span <= length:
                prefix[span] = rank
            if span > 4 * n:
                break
        self.rows = n
        before = data[order - 1]  # the last byte, a closing one, stands before the first
        head = np.r_[True, before[1:] != before[:-1]]
        self.starts = np.flatnonzero(head)
        heads = before[self.starts]
        lengths = np.diff(np.r_[self.starts, n])
        by_byte = np.argsort(heads, kind="stable")
        self.jump = np.empty(len(heads), np.int64)
        self.jump[by_byte] = np.cumsum(lengths[by_byte]) - lengths[by_byte]
        # Ranges of rows that agree on ``length`` bytes: two overlapping prefixes of a known power of two.
        span = max(prefix)
        near, far = prefix[span], np.r_[prefix[span][length - span :], np.full(length - span, -1)]
        same = (near[order[1:]] == near[order[:-1]]) & (far[order[1:]] == far[order[:-1]])
        self.blocks = np.flatnonzero(np.r_[True, ~same])
        ends = np.cumsum(self.sizes + 1) - 1
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.closing = place[ends]
        self.least = np.minimum.reduceat(low[np.searchsorted(ends, order, "left")], self.blocks)

    @staticmethod
    def _ranks(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.r_[False, sorted_keys[1:] != sorted_keys[:-1]])
        return rank

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one byte longer."""
        run = np.searchsorted(self.starts, rows, "right") - 1
        return self.jump[run] + rows - self.starts[run]

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, least): for every position with ``length`` bytes left, the least value of ``low`` among the
        texts that hold those bytes."""
        texts = np.arange(len(self.sizes))
        rows, left = self.closing.copy(), self.sizes.copy()
        out = []
        while True:
            going = left > 0
            texts, rows, left = texts[going], rows[going], left[going] - 1
            if not len(texts):
                break
            rows = self.back(rows)
            enough = left <= self.sizes[texts] - self.length
            block = np.searchsorted(self.blocks, rows[enough], "right") - 1
            out.append((texts[enough], left[enough], self.least[block]))
        return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))


def smallest_owners(found: DataFrame, options: SuffixDedup, partitions: int) -> DataFrame:
    """k1, k2 (of the context), owners: for each of its windows the smallest doc_id that has it. Contexts for which
    that takes nothing away are left out."""
    rows = found.groupBy("context").agg(F.min("hash").alias("hash"), F.min("doc").alias("low"), F.max("doc").alias("high"))

    def run(batches):
        for groups in whole_groups(batches):  # sorted by hash
            alone, chosen = [], []
            for texts, lows, highs in groups:
                if len(texts) > 1:
                    chosen.append((texts, lows, highs))
                elif lows[0] < highs[0]:
                    alone.append((texts[0], lows[0]))  # an index of one text: its windows have its own smallest doc_id
            found = [(t, np.full(len(t) - options.length + 1, low)) for t, low in alone]
            if chosen:
                found += indexed([t for g in chosen for t in g[0]], *(np.concatenate([g[i] for g in chosen]) for i in (1, 2)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in found], pa.binary()), pa.array([r[1] for r in found], pa.list_(pa.int64()))], names=["context", "owners"]
            )

    def whole_groups(batches):
        """Lists of (texts, low, high), one for each anchor hash, with about ``chunk_bytes`` of text together."""
        made, size, held = [], 0, None
        for b in batches:
            hashes, lows, highs, texts = (b.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "low", "high", "context"))
            cuts = np.r_[0, np.flatnonzero(hashes[1:] != hashes[:-1]) + 1, len(hashes)].tolist() if len(hashes) else []
            for x, y in zip(cuts, cuts[1:]):
                part = ([texts[x:y]], [lows[x:y]], [highs[x:y]])
                if held and held[0] == hashes[x]:
                    for mine, more in zip(held[1], part):
                        mine += more
                    continue
                if held:
                    made.append([np.concatenate(p) for p in held[1]])
                    size += sum(map(len, made[-1][0]))
                    if size >= options.chunk_bytes:
                        yield made
                        made, size = [], 0
                held = (hashes[x], part)
        if held:
            yield made + [[np.concatenate(p) for p in held[1]]]

    def indexed(texts, lows, highs):
        # Byte 0 closes texts inside the index, so the one text byte it could be mistaken for moves up by one; so do all
        # others, and 255 and 254, which UTF-8 never uses, leave the room.
        text, position, least = RunLengthIndex([t.translate(UP) for t in texts], lows, options.length).stream()
        by_text = np.lexsort((position, text))
        text, least = text[by_text], least[by_text]
        ends = np.flatnonzero(np.r_[text[1:] != text[:-1], True]) + 1
        begins = np.r_[0, ends[:-1]]
        takes = np.minimum.reduceat(least, begins) < highs[text[begins]]
        return [(texts[t], least[a:b]) for t, a, b, k in zip(text[begins], begins, ends, takes) if k]

    out = rows.repartition(partitions, "hash").sortWithinPartitions("hash", "low").mapInArrow(run, "context binary, owners array<long>")
    return out.select(*_keys(), "owners")


UP = bytes([min(i + 1, 255) for i in range(256)])


def _keys() -> list:
    return [F.xxhash64("context").alias("k1"), F.xxhash64(F.lit(1), "context").alias("k2")]


def repeated_spans(docs: DataFrame, scratch: Scratch, options: SuffixDedup = SuffixDedup()) -> tuple[DataFrame, DataFrame]:
    """The documents (doc, text and other columns) with ``twin``, and (doc, twin, spans): packed 32-bit begin and end of
    each removed run, for texts that lose anything."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs, marks = with_twins(docs, scratch.cut(marks_of(docs), "marks"))
    twins = scratch.cut(copies(marks, options), "copies")
    rows = docs.where(f"doc is not null and octet_length(text) >= {options.length}").select("doc", "twin", "text")
    rows = restrict(rows, ["doc", "twin"], twins.select("doc", "twin"), options.broadcast_ids, "left_anti")
    shared = scratch.cut(shared_anchors(rows, options), "shared")
    found = scratch.cut(contexts(rows, shared, options), "contexts")
    scratch.drop("shared")
    owners = scratch.cut(smallest_owners(found, options, partitions), "owners")
    places = found.select(*_keys(), "doc", "twin", "first")
    hits = places.join(owners, ["k1", "k2"]).where(F.exists("owners", lambda o: o < F.col("doc")))

    def run(batches):
        for batch in batches:
            doc, first = batch.column("doc").to_numpy(), batch.column("first").to_numpy().astype(np.int64)
            owners = batch.column("owners")
            edges = owners.offsets.to_numpy().astype(np.int64)
            flat, edges = owners.flatten().to_numpy(), edges - edges[0]
            row = np.repeat(np.arange(len(doc)), np.diff(edges))
            marked = flat < doc[row]
            # Runs of marked windows of one row, as spans of bytes.
            inner = np.r_[False, (row[1:] == row[:-1]) & marked[:-1]]
            begin = np.flatnonzero(marked & ~inner)
            end = np.flatnonzero(marked & ~np.r_[inner[1:] & marked[1:], False])
            at = first[row[begin]] - edges[row[begin]]
            spans = np.stack([at + begin, at + end + options.length], axis=1).astype("<i4")
            owner, twin = doc[row[begin]], batch.column("twin").to_numpy()[row[begin]]
            order = np.lexsort((twin, owner))
            owner, twin, spans = owner[order], twin[order], spans[order]
            cuts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (twin[1:] != twin[:-1])][: len(owner)])
            ends = np.r_[cuts[1:], len(owner)][: len(cuts)]
            packed = [spans[x:y].tobytes() for x, y in zip(cuts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(owner[cuts], pa.int64()), pa.array(twin[cuts], pa.int32()), pa.array(packed, pa.binary())], names=["doc", "twin", "span"])

    pieces = hits.select("doc", "twin", "first", "owners").mapInArrow(run, "doc long, twin int, span binary")

    def whole(batches):
        for batch in batches:
            spans = [[np.array([0, n], "<i4").tobytes()] for n in batch.column("size").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("twin"), pa.array(spans, pa.list_(pa.binary()))], names=["doc", "twin", "spans"])

    cut = pieces.groupBy("doc", "twin").agg(F.collect_list("span").alias("spans"))
    out = scratch.cut(cut.unionByName(twins.mapInArrow(whole, "doc long, twin int, spans array<binary>")), "spans")
    scratch.drop("contexts", "owners")
    return docs, out


def _merge(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans as maximal ones, a row each of begin and end."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, begins[1:] > ends[:-1]]
    return np.stack([begins[new], ends[np.r_[np.flatnonzero(new)[1:], len(ends)] - 1]], axis=1).astype("<i4")


def kept_bytes(text: str | None, spans: list[bytes] | None) -> tuple[bytes, int, int]:
    """What remains, the number of bytes removed, and of maximal removed runs."""
    data = (text or "").encode()
    if not spans:
        return data, 0, 0
    flat = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2).astype(np.int64)
    merged = _merge(flat[:, 0], flat[:, 1])
    out, at = [], 0
    for begin, end in merged.tolist():
        out.append(data[at:begin])
        at = end
    out.append(data[at:])
    kept = b"".join(out)
    return kept, len(data) - len(kept), len(merged)


def split_by_loss(docs: DataFrame, spans: DataFrame, options: SuffixDedup) -> tuple[DataFrame, DataFrame]:
    """Texts that lose nothing, and those that do, with their spans. While their ids are few enough to be broadcast only
    the latter travel."""
    keys, ids = ["doc", "twin"], spans.select("doc", "twin")
    whole = restrict(docs, keys, ids, options.broadcast_ids, "left_anti")
    return whole, restrict(docs, keys, ids, options.broadcast_ids).join(spans, keys)


def digests(docs: DataFrame, options: SuffixDedup = SuffixDedup()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    whole, cut = split_by_loss(*repeated_spans(docs, scratch, options), options)

    def run(batches):
        for rows in batches_of(batches, ["doc", "text", "spans"]):
            found = [(r[0], len((r[1] or "").encode()), *kept_bytes(r[1], r[2])) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64()),
                 pa.array([x[4] for x in found], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    same = whole.select(F.col("doc").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return same.unionByName(cut.select("doc", "text", "spans").mapInArrow(run, schema))


def without_repeats(docs: DataFrame, options: SuffixDedup = SuffixDedup()) -> DataFrame:
    """All rows, with what repeats an earlier document cut out of the text, and n_chars counted anew where something
    was. A character that a cut leaves incomplete goes with it. Columns keep their names, whatever they are."""
    scratch = Scratch(docs.sparkSession, "suffix")
    names, schema = docs.columns, docs.schema
    other = [f"c{i}" for i in range(len(names))]  # while spans are looked for, so that no name clashes
    at = {n.lower(): c for n, c in zip(names, other)}
    rows = docs.toDF(*other).withColumn("doc", F.col(at["doc_id"]).cast("long")).withColumnRenamed(at["text"], "text")
    columns = ["text" if c == at["text"] else c for c in other]
    whole, cut = split_by_loss(*repeated_spans(rows, scratch, options), options)

    def run(batches):
        for batch in slices_of(batches, "text"):
            pairs = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            kept = pa.array([kept_bytes(t, s)[0].decode(errors="ignore") for t, s in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([kept if c == "text" else batch.column(c) for c in columns], names=columns)

    shorter = cut.select(*columns, "spans").mapInArrow(run, rows.select(*columns).schema)
    if "n_chars" in at:
        shorter = shorter.withColumn(at["n_chars"], F.length("text").cast(schema[names[other.index(at["n_chars"])]].dataType))
    return whole.select(*columns).unionByName(shorter).toDF(*names)
