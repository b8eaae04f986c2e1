"""Exact Jaccard self-join of documents' shingle sets, by token-combination prefixes.

A document's set holds the hashes (64 bits) of its distinct shingles of ``width`` words. Documents with equal sets
are one class, found by a 128-bit fingerprint; the join works on one representative of each.

Candidates come from two prefix filters, one inside the other:

1. Of a set of n, any partner shares at least a = ceil(t n). In one global order (by hash) the first n - a + j of both
   sets share at least j tokens. Only these *lists* are counted and exchanged, never whole sets: packed, a token
   once, to the task that counts it, and back to the document only if another list holds it too.
2. Inside the lists tokens are ordered anew, rare ones first. Lists that share j tokens share k of their first
   (length - j + k). Tokens found in one list only come first of all and need no index entry; a document whose
   prefix consists of them has no partner.

The index holds single tokens where they are rare (in at most ``rare`` lists). Frequent tokens are dealt by hash into
B classes, and only pairs of one class are indexed; with k = B + 1 shared tokens either one of them is rare, or some
class has two of them. B grows with the set size, in bands of powers of two, so an index never has more than about as
many entries as the document has shingles; a document near the edge of a band is indexed in both. A token that fills
a batch (``hot`` of its lists) is counted there at once; such tokens are the most frequent class of all, ordered by hash.

Entries are also dealt by size, so that only documents of similar size share a group; one near the edge of a size class is
in two. A group of at most ``small`` documents proposes its pairs, a number bounded by a constant per entry. A larger
group never does:

* It names its most central document the leader, and every other is a candidate with it alone.
* What is left to find are links of documents x that are not connected with their leader c. If x and y are linked and
  D(x), D(y) are their differences from c, then |D(x) ^ D(y)| = |x ^ y| <= T(x, y) = k (|x| + |y|) with k = (100 - percent) /
  (100 + percent), so they share at least (|D(x)| + |D(y)| - T) / 2 tokens of their differences; ``least_common`` turns that
  into a bound for one side alone. So a third prefix filter, over differences, rare tokens of the leader's group
  first, finds every such pair. A token that only one difference holds needs no entry; where texts differ by words of
  their own, that is half of each difference and leaves next to nothing to index. The leader's tokens that a document
  lacks are counted only where the document's own do not fill its prefix, and of a document far from its leader only the
  first of its own, by hash, that are sure to hold ``spare`` shared ones.

Candidates are first screened by parity sketches: bit h mod b of a set's sketch tells whether an odd number of its
tokens falls there, so two sketches never differ in more bits than their sets in tokens. Only pairs that pass are
compared token by token.

Contract: 100 |x & y| >= percent |x | y|. Defined results: a null, empty or wordless text has an empty set, its own
component, and no links; a text of fewer than ``width`` words has its whole sequence as the only shingle; a null
doc_id has a null component; an empty table gives an empty one. Rows that share a doc_id are one document with one
component: each row is answered by its own set's size and equals, and the smallest of their texts stands for all when
similar ones are searched. Only doc_id and text are read, so other columns and their names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch, batches_of, partition_names, restrict
from cohortlab.llm.components import Components


@dataclass(frozen=True)
class JaccardJoin:
    width: int = 5
    percent: int = 80
    rare: int = 24
    hot: int = 16  # lists of one batch that hold a token
    small: int = 8  # documents of a group that proposes all its pairs
    size_ratio: float = 1.3  # of size classes; above 100 / percent
    batch_bytes: int = 1 << 20
    spare: int = 8  # shared tokens that the lists of the third filter are sure to hold, where they are not whole
    broadcast_ids: int = 1_000_000  # a list of ids is broadcast up to this size, and joined by a shuffle beyond it

    def least_shared(self, n):
        """What a set of n shares at least with any partner."""
        return -(-self.percent * n // 100)

    def extra(self, n):
        """j of the first filter; never falls with n."""
        return np.minimum(self.least_shared(n), 3 + n * (100 - self.percent) // 160)

    def listed(self, n):
        """Length of the list of a set of n."""
        return n - self.least_shared(n) + self.extra(n)

    def least_size(self, n):
        return -(-self.percent * n // 100)

    def most_size(self, n):
        return n * 100 // self.percent

    def classes(self, n) -> int:
        """B for a set of n: at most a 64th of it for every tenth that may differ."""
        share = max(1, int(n) * (100 - self.percent) // 640)
        return 1 << (share.bit_length() - 1)

    @property
    def least(self) -> int:
        """Smaller sets have only their equals: one differing shingle breaks the link."""
        return next(n for n in range(1, 200) if 100 * n >= self.percent * (n + 1))


MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
HOT_COUNT = 1 << 40


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# Shingles ----------------------------------------------------------------------------------------------------

CHUNK = 1 << 16
LONG_WORD = 256
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FACTOR = 0x9E3779B97F4A7C15  # odd, so that it has an inverse


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for every byte, the same for A-Z and a-z; powers of the factor; and their inverses."""
    value = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[1])
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    power = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(CHUNK - 1, x, np.uint64)])
    return value, power(FACTOR), power(pow(FACTOR, -1, 1 << 64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of UTF-8 bytes, A-Z as a-z: a polynomial over the word's bytes, from running sums
    over chunks that end between words; long words by another hash."""
    value, power, inverse = _powers()
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        part = np.frombuffer(data, np.uint8, end - at, at)
        blank = BLANK[part]
        edge = np.flatnonzero(np.diff(np.r_[True, blank, True].view(np.int8)))
        first, last = edge[::2], edge[1::2]
        if end < len(data) and len(last) and last[-1] == len(part):  # the last word may go on in the next chunk
            if first[-1] > 0:
                end = at + int(first[-1])
            else:
                while end < len(data) and not BLANK[data[end]]:
                    end += 1
                hashes.append(np.array([xxhash.xxh3_64_intdigest(data[at:end].lower())], np.uint64))
                firsts.append(np.array([at]))
            first, last = first[:-1], last[:-1]
        if len(first):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(value[part] * power[: len(part)], out=total[1:])
            found = mixed((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64) * MULTIPLIERS[2])
            for i in np.flatnonzero(last - first > LONG_WORD).tolist():
                found[i] = xxhash.xxh3_64_intdigest(data[at + int(first[i]) : at + int(last[i])].lower())
            hashes.append(found)
            firsts.append(at + first)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    encoded = [(t or "").encode() for t in texts]
    hashes, firsts = word_hashes(b" ".join(encoded))
    begins = np.cumsum([0] + [len(e) + 1 for e in encoded])
    cuts = np.searchsorted(firsts, begins).tolist()

    def combined(width: int, hashes: np.ndarray) -> np.ndarray:
        windows = len(hashes) - width + 1
        total = np.full(max(0, windows), width, np.uint64)
        for i in range(width if windows > 0 else 0):
            total += mixed(hashes[i : windows + i] + MULTIPLIERS[i % 5] * np.uint64(1 + i // 5)) * MULTIPLIERS[-1 - i % 5]
        return mixed(total)

    everywhere, out = combined(width, hashes), []
    for a, b in zip(cuts, cuts[1:]):
        found = everywhere[a : b - width + 1] if b - a >= width else combined(b - a, hashes[a:b]) if b > a else hashes[:0]
        found = np.sort(found)
        out.append(found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found)
    return out


def sketch(found: np.ndarray) -> bytes:
    """Parities of a set of n by the hash modulo a power of two from 2 n on."""
    bits = max(64, 1 << (2 * len(found)).bit_length())
    counts = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def least_distance(a: bytes, b: bytes) -> int:
    """Two sets differ by at least so many tokens; a larger sketch is folded to the size of the other."""
    if len(a) < len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def fingerprints(docs: DataFrame, options: JaccardJoin) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint (f1, f2) and sketch."""

    def run(batches):
        for rows in batches_of(batches, ["doc_id", "text"], options.batch_bytes):
            sets = shingle_sets([r[1] for r in rows], options.width)
            marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                 pa.array([sketch(s) if len(s) >= options.least else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "f1", "f2", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


# Index -------------------------------------------------------------------------------------------------------


def index_keys(n: int, listed: int, matched: np.ndarray, counts: np.ndarray, options: JaccardJoin) -> np.ndarray:
    """Index keys of one document. matched, counts: its list's tokens that others have too, and the lists that hold each."""
    sizes = range(options.least_size(n), options.most_size(n) + 1)
    bands = sorted({options.classes(sizes[0]), options.classes(n), options.classes(sizes[-1])})
    band = bands[0]
    while band < bands[-1]:
        band *= 2
        bands = sorted({*bands, band})
    least = int(options.extra(options.least_size(n)))
    shared = min(least, 1 + bands[-1])
    prefix = listed - least + shared - (listed - len(matched))
    if prefix <= 0:
        return np.empty(0, np.uint64)
    chosen = np.lexsort((matched, counts))[:prefix]
    rare = counts[chosen] <= options.rare
    often = matched[chosen[~rare]]
    keys = [matched[chosen[rare]]]
    for band in bands if len(often) > 1 else []:
        dealt = mixed(often) % np.uint64(band)
        order = np.lexsort((often, dealt))
        own_class, own = dealt[order], often[order]
        # Pairs of one class: each token with those some places further on, as long as any has.
        for step in range(1, len(own)):
            same = own_class[step:] == own_class[:-step]
            if not same.any():
                break
            keys.append(mixed(own[:-step][same] * MULTIPLIERS[0] + own[step:][same] * MULTIPLIERS[1] + np.uint64(band)))
    return np.unique(np.concatenate(keys))


HEADER = np.dtype([("doc", "<i8"), ("n", "<u4"), ("k", "<u4")])


def _pack(docs: np.ndarray, sizes: np.ndarray, *columns: np.ndarray) -> bytes:
    """Rows grouped by document: the number of groups, their headers, and the columns of 64-bit numbers."""
    cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    head = np.empty(len(cuts), HEADER)
    head["doc"], head["n"], head["k"] = docs[cuts], sizes[cuts], np.diff(np.r_[cuts, len(docs)])
    return len(cuts).to_bytes(4, "little") + head.tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(blobs: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """docs, sizes and the columns of all blobs, a number for each row."""
    docs, sizes, columns = [], [], [[] for _ in range(width)]
    for blob in blobs:
        groups = int.from_bytes(blob[:4], "little")
        head = np.frombuffer(blob, HEADER, groups, 4)
        docs.append(np.repeat(head["doc"], head["k"]))
        sizes.append(np.repeat(head["n"], head["k"]))
        rows = np.frombuffer(blob, np.uint64, -1, 4 + HEADER.itemsize * groups).reshape(width, -1)
        for column, row in zip(columns, rows):
            column.append(row)
    return tuple(np.concatenate(x) for x in (docs, sizes, *columns))


def _dealt(kind: str, bucket: np.ndarray, docs: np.ndarray, sizes: np.ndarray, *columns: np.ndarray) -> list[tuple[int, str, bytes]]:
    """(bucket, kind, blob) of every bucket's rows."""
    order = np.lexsort((docs, bucket))
    bucket, docs, sizes, columns = bucket[order], docs[order], sizes[order], [c[order] for c in columns]
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]), len(bucket)]
    return [(int(bucket[a]), kind, _pack(docs[a:b], sizes[a:b], *(c[a:b] for c in columns))) for a, b in zip(cuts[:-1], cuts[1:])]


def _entries(docs: DataFrame, options: JaccardJoin) -> DataFrame:
    """grp, rep, n, place for every index entry; the least place in a group is its most central document's: few tokens of
    its own, and the others' tokens in common."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Kinds of blobs: t, tokens to count; h, hot tokens of one batch; m, tokens that other lists hold, with counts.
    schema = "bucket int, kind string, blob binary"

    names = partition_names(parts)

    def spread(values: np.ndarray) -> np.ndarray:
        return names[(mixed(values.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)]

    def batch(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.binary()))], names=["bucket", "kind", "blob"])

    def blobs(batches):
        found: dict[str, list[bytes]] = {"t": [], "h": [], "m": []}
        for b in batches:
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist()):
                found[kind].append(blob)
        return found

    def give(batches):
        for rows in batches_of(batches, ["doc_id", "text"], options.batch_bytes):
            sets = shingle_sets([r[1] for r in rows], options.width)
            lists = [s[: options.listed(len(s))] if len(s) >= options.least else s[:0] for s in sets]
            lengths = [len(x) for x in lists]
            docs = np.repeat(np.array([r[0] for r in rows], np.int64), lengths)
            sizes = np.repeat(np.array([len(s) for s in sets], np.int64), lengths)
            tokens = np.concatenate(lists)
            if not len(tokens):
                continue
            values, which, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            hot = counts[which] >= options.hot
            out = _dealt("t", spread(tokens[~hot]), docs[~hot], sizes[~hot], tokens[~hot])
            if hot.any():
                # The lists' own part stays with the documents; the counting task learns of each hot token once.
                out += _dealt("m", spread(docs[hot]), docs[hot], sizes[hot], tokens[hot], np.full(hot.sum(), HOT_COUNT, np.uint64))
                named = values[counts >= options.hot]
                none = np.zeros(len(named), np.int64)
                out += _dealt("h", spread(named), none, none, named)
            yield batch(out)

    def meet(batches):
        found = blobs(batches)
        if found["m"]:  # on their way to the documents' tasks
            for a in range(0, len(found["m"]), 1000):
                part = found["m"][a : a + 1000]
                first = np.array([int.from_bytes(b[4:12], "little", signed=True) for b in part])
                yield batch(list(zip(spread(first).tolist(), ["m"] * len(part), part)))
        if not found["t"]:
            return
        docs, sizes, tokens = _unpack(found.pop("t"), 1)
        order = np.argsort(tokens, kind="stable")
        docs, sizes, tokens = docs[order], sizes[order], tokens[order]
        cuts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        lengths = np.diff(np.r_[cuts, len(tokens)])
        counts = np.where(np.isin(tokens[cuts], _unpack(found["h"], 1)[2]), HOT_COUNT, lengths) if found["h"] else lengths
        counts = np.repeat(counts, lengths)
        keep = counts > 1
        if keep.any():
            yield batch(_dealt("m", spread(docs[keep]), docs[keep], sizes[keep], tokens[keep], counts[keep].astype(np.uint64)))

    def gather(batches):
        found = blobs(batches)["m"]
        if not found:
            return
        docs, sizes, tokens, counts = _unpack(found, 2)
        order = np.argsort(docs, kind="stable")
        docs, sizes, tokens, counts = docs[order], sizes[order], tokens[order], counts[order].astype(np.int64)
        cuts = np.r_[np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]), len(docs)].tolist()
        made: list[tuple] = []
        waiting = 0

        def table():
            keys = np.concatenate([m[0] for m in made])
            repeat = lambda i: np.repeat(np.array([m[i] for m in made], np.int64), [len(m[0]) for m in made])
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(repeat(i)) for i in (1, 2, 3))], names=["grp", "rep", "n", "place"])

        for a, b in zip(cuts, cuts[1:]):
            n = int(sizes[a])
            listed = int(options.listed(n))
            own = index_keys(n, listed, tokens[a:b], counts[a:b], options)
            if not len(own):
                continue
            # Sizes of a linked pair differ by less than a class, so one class up and its own hold both.
            size = int(np.log(n) / np.log(options.size_ratio))
            own = np.concatenate([mixed(own + np.uint64((size + i) * int(MULTIPLIERS[3]) % (1 << 64))) for i in (0, 1)])
            made.append((own, int(docs[a]), n, (listed - (b - a)) * (1 << 24) - int(np.minimum(counts[a:b], 1 << 20).mean())))
            waiting += len(own)
            if waiting > 200_000:
                yield table()
                made, waiting = [], 0
        if made:
            yield table()

    met = docs.mapInArrow(give, schema).repartition(parts, "bucket").mapInArrow(meet, schema)
    return met.repartition(parts, "bucket").mapInArrow(gather, "grp long, rep long, n long, place long")


def _groups(entries: DataFrame, options: JaccardJoin) -> tuple[DataFrame, DataFrame]:
    """Groups of two as (a, b), and the entries of larger ones with the group's leader and number of documents."""
    found = entries.groupBy("grp").agg(F.min(F.struct("place", "rep")).alias("l"), F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("k"))
    large = found.where("k > 2").select("grp", "k", F.col("l.rep").alias("lead"))
    return found.where("k = 2").select("a", "b"), entries.join(large, "grp").select("grp", "rep", "n", "lead", "k")


def _small_pairs(members: DataFrame, options: JaccardJoin) -> DataFrame:
    """The pairs of groups of at most ``small`` documents, whose sizes allow a link."""
    rows = members.where(F.col("k") <= options.small).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("n", "rep"))).alias("m"))
    pairs = rows.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    able = 100 * F.col("x.n") >= options.percent * F.col("y.n")
    return pairs.where(able).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


# Verification ------------------------------------------------------------------------------------------------


def _only(df: DataFrame, key: str, ids: DataFrame, options: JaccardJoin, how: str = "left_semi") -> DataFrame:
    return restrict(df, [key], ids, options.broadcast_ids, how)


def _likely(pairs: DataFrame, sketches: DataFrame, options: JaccardJoin) -> DataFrame:
    """(a, b) whose sketches do not rule out a link."""
    side = lambda k: sketches.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((100 * F.col("na") >= options.percent * F.col("nb")) & (100 * F.col("nb") >= options.percent * F.col("na")))

    def run(batches):
        for rows in batches_of(batches, ["a", "b", "sa", "sb", "na", "nb"]):
            able = [r[:2] for r in rows if (100 + options.percent) * least_distance(r[2], r[3]) <= (100 - options.percent) * (r[4] + r[5])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in able], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, options: JaccardJoin) -> DataFrame:
    """rep, items: the whole shingle sets of the wanted documents."""

    def run(batches):
        for rows in batches_of(batches, ["doc_id", "text"], options.batch_bytes):
            items = [s.view(np.int64) for s in shingle_sets([r[1] for r in rows], options.width)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=["rep", "items"])

    return _only(docs, "doc_id", wanted, options).mapInArrow(run, "rep long, items array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, options: JaccardJoin) -> DataFrame:
    """The links among the pairs (a, b), by their whole sets."""
    one = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("shared") >= options.percent * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For (lead, rep) and the columns that come with them: n and m, the sizes of rep's and lead's sets, and the tokens that
    one of both has: ``own`` of rep, ``lost`` of lead."""
    own = sets.select("rep", F.col("items").alias("x"))
    lead = sets.select(F.col("rep").alias("lead"), F.col("items").alias("of_lead"))
    both = pairs.join(own, "rep").join(lead, "lead")
    return both.select(*pairs.columns, F.size("x").alias("n"), F.size("of_lead").alias("m"), F.array_except("x", "of_lead").alias("own"), F.array_except("of_lead", "x").alias("lost"))


def least_common(d, n, m, options: JaccardJoin):
    """What the difference d of a set of n from a leader of m shares at least with that of a partner: (if the partner is
    not linked with the leader, if it is or may be). For a linked document the partner never is."""
    low, high = 100 - options.percent, 100 + options.percent
    linked = high * d <= low * (n + m)
    # T of the largest partner, and half of what d exceeds the partner's own least or most distance by.
    far = d - F.floor(low * (n + F.floor(100 * n / options.percent)) / high)
    half = F.floor((high * d + low * (m - n)) / (2 * high)) + 1
    half = F.greatest(half, F.lit(1))
    return F.when(linked, half).otherwise(F.greatest(half, far)), F.when(linked, half).otherwise(F.greatest(far, F.lit(1)))


def _held(rows: DataFrame) -> DataFrame:
    """lead, rep, t: of the rows (lead, rep, token) those whose token several documents of the leader have, with how many."""
    often = rows.groupBy("lead", "token").agg(F.count("*").alias("c")).where("c > 1")
    return rows.join(often, ["lead", "token"]).groupBy("lead", "rep").agg(F.collect_list(F.struct("c", "token")).alias("t"))


def _listed(differences: DataFrame, options: JaccardJoin) -> DataFrame:
    """Instead of rep's own tokens those of them that are counted, as ``own``, and what is known of (lead, rep): d, the size of the
    difference; w and l, of its parts; near, whether they are linked; prefixes q and r of d, and p; far; ``last``.

    A linked pair's first shared token is among the first r = d - o + 1 of either difference (q if the partner is not linked with
    the leader), and as both share least_shared of their whole sets, one of their own is among the first n - a + 1 of rep's own if
    these are as many. p is the smaller bound, and the k-th shared token of their own is among the first p + k - 1 by hash. A far
    document, not linked with its leader, has p + spare - 1 of its own or more, so it shares at least ``spare`` of its own with
    any partner: it lists the first p + spare - 1 up to the token ``last``, and no tokens of the leader's. Others list all."""
    low, high = 100 - options.percent, 100 + options.percent
    size = F.size("own") + F.size("lost")
    strict, loose = least_common(size, F.col("n"), F.col("m"), options)
    about = differences.withColumns({"d": size, "near": high * size <= low * (F.col("n") + F.col("m")), "q": size - strict + 1, "r": size - loose + 1, "w": F.size("own"), "l": F.size("lost")})
    about = about.withColumn("p", F.greatest(F.lit(1), F.least("r", F.floor(low * F.col("n") / 100) + 1)))
    about = about.withColumn("far", ~F.col("near") & (F.col("w") >= F.col("p") + options.spare - 1))
    first = F.slice(F.sort_array("own"), F.lit(1), (F.col("p") + options.spare - 1).cast("int"))
    about = about.withColumn("own", F.when(F.col("far"), first).otherwise(F.col("own")))
    about = about.withColumn("lost", F.when(F.col("far"), F.slice("lost", 1, 0)).otherwise(F.col("lost")))
    return about.withColumn("last", F.when(F.col("far"), F.element_at("own", -1)).otherwise(F.lit((1 << 63) - 1)))


def _difference_entries(listed: DataFrame, own: DataFrame, options: JaccardJoin) -> DataFrame:
    """lead, rep, label, loose, near, far, n, d, last, left, token, early, full, deep: entries of the third filter. own: what ``_held``
    finds among the documents' own tokens. Those that at most ``rare`` have come first, then all others, rare ones first. So
    whoever has enough rare ones lists no tokens of the leader's. ``left``: how many tokens that other differences may hold too the
    document has from this one on. ``early`` entries meet those of far documents, as ``spare`` shared ones are left from there;
    ``full`` ones meet the others', a deep one only if that document is linked with the leader."""
    tokens = lambda name: F.coalesce(name, F.array().cast("array<struct<c:bigint,token:bigint>>"))
    about = listed.join(own.withColumnRenamed("t", "mine"), ["lead", "rep"], "left").withColumn("mine", F.sort_array(tokens("mine")))
    about = about.withColumn("listed", F.size("own")).drop("own")
    late = lambda e: e["c"] > options.rare
    short = ~F.col("far") & (F.col("w") - F.size(F.filter("mine", late)) < F.col("r"))
    lost = _held(about.where(short).select("lead", "rep", F.explode("lost").alias("token")))
    both = about.join(lost.withColumnRenamed("t", "theirs"), ["lead", "rep"], "left").withColumn("theirs", tokens("theirs"))
    both = both.withColumns({"alone": F.col("listed") - F.size("mine"), "alone_late": F.size("lost") - F.size("theirs"), "held": F.size("mine")}).drop("lost")
    entry = lambda e, late, rank: F.struct(late.alias("late"), e["c"].alias("c"), e["token"].alias("token"), rank.alias("rank"))
    mine = F.transform("mine", lambda e, i: entry(e, late(e), i))
    theirs = F.transform("theirs", lambda e: entry(e, F.lit(True), F.lit(None).cast("int")))
    both = both.withColumn("t", F.sort_array(F.concat(mine, theirs))).withColumn("size", F.size("t")).drop("mine", "theirs")

    def placed(e, i):
        place = i + F.col("alone") + F.when(e["late"], F.col("alone_late")).otherwise(0)
        # Before the late ones any of the leader's may still be shared, with documents that do not list theirs too; those that a
        # far one does not list may be shared wherever it is.
        left = F.when(F.col("far"), F.col("held") - i + F.col("w") - F.col("listed") + F.col("l"))
        left = left.when(e["late"], F.col("size") - i).otherwise(F.col("held") - i + F.col("l"))
        early = F.coalesce(e["rank"] + F.col("alone") <= F.col("listed") - options.spare, F.lit(False))
        full = F.when(F.col("far"), early).otherwise(place < F.col("r"))
        return F.struct(e["token"].alias("token"), left.alias("left"), early.alias("early"), full.alias("full"), (place >= F.col("q")).alias("deep"))

    kept = F.filter(F.transform("t", placed), lambda e: e["early"] | e["full"])
    return both.select("lead", "rep", "label", "loose", "near", "far", "n", "d", "last", F.explode(kept).alias("e")).select("*", "e.*").drop("e")


def _second_pairs(entries: DataFrame, options: JaccardJoin) -> DataFrame:
    """(a, b): one is loose, their labels differ, the prefixes of their differences share a token, and what either still
    has from that token on suffices for a link. (At the first token of all that two linked documents list and share it does. Of
    two that do not list all, this holds for the one whose list ends first: the other lists all that both have up to there.)"""
    names = ["rep", "label", "loose", "near", "far", "n", "d", "last", "left", "early", "full", "deep"]
    x, y = (entries.select("lead", "token", *[F.col(c).alias(f"{c}_{k}") for c in names]) for k in "xy")
    low, high = 100 - options.percent, 100 + options.percent
    left = F.when(F.col("last_x") < F.col("last_y"), F.col("left_x")).when(F.col("last_y") < F.col("last_x"), F.col("left_y")).otherwise(F.least("left_x", "left_y"))
    enough = 2 * high * left >= high * (F.col("d_x") + F.col("d_y")) - low * (F.col("n_x") + F.col("n_y"))
    sizes = (100 * F.col("n_x") >= options.percent * F.col("n_y")) & (100 * F.col("n_y") >= options.percent * F.col("n_x"))
    others = F.col("full_x") & F.col("full_y") & (F.col("near_y") | ~(F.col("deep_x") | F.col("deep_y")))
    able = F.when(F.col("far_x") | F.col("far_y"), F.col("early_x") & F.col("early_y")).otherwise(others)
    once = (F.col("label_x") != F.col("label_y")) & ~(F.col("loose_y") & (F.col("rep_x") > F.col("rep_y")))
    met = x.where("loose_x").join(y, ["lead", "token"]).where(enough & sizes & able & once)
    return met.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def link(docs: DataFrame, options: JaccardJoin = JaccardJoin()) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.cut(fingerprints(docs, options), "rows")
    known = rows.where("doc_id is not null")
    again = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = None if again.isEmpty() else scratch.cut(again, "again")
    if again is not None:
        single = scratch.cut(_only(docs, "doc_id", again, options).groupBy("doc_id").agg(F.min("text").alias("text")), "single")
        docs = _only(docs, "doc_id", again, options, "left_anti").unionByName(single)
        known = scratch.cut(_only(known, "doc_id", again, options, "left_anti").unionByName(fingerprints(single, options)), "once")
    searched = known.where(f"n_shingles >= {options.least}")
    classes = searched.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1")
    copies = scratch.cut(searched.join(classes, ["f1", "f2"]).where("doc_id > rep").select("doc_id"), "copies")
    docs = _only(docs.where("doc_id is not null"), "doc_id", copies, options, "left_anti")

    entries = scratch.cut(_entries(docs, options), "entries")
    twos, members = _groups(entries, options)
    members = scratch.cut(members, "members")
    stars = scratch.cut(members.where((F.col("k") > options.small) & (F.col("rep") != F.col("lead"))).select("lead", "rep").distinct(), "stars")
    starred = stars.select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b"))
    pairs = scratch.cut(twos.unionByName(_small_pairs(members, options)).unionByName(starred).distinct(), "pairs")
    scratch.drop("entries", "members")
    found = Components(scratch)

    def add(pairs: DataFrame, name: str, sets: DataFrame | None = None) -> None:
        sketches = known.select("doc_id", "n_shingles", "sketch")
        likely = scratch.cut(_likely(pairs, sketches, options), f"likely-{name}")
        if likely.isEmpty():
            return
        if sets is None:
            sets = scratch.cut(_sets(docs, likely.select("a").union(likely.select("b")), options), f"sets-{name}")
        links = scratch.cut(_linked(likely, sets, options), f"links-{name}")
        scratch.drop(f"sets-{name}", f"likely-{name}")
        if not links.isEmpty():
            found.add(links)

    add(pairs, "first")
    scratch.drop("pairs")
    # Leaders with a document that is not connected with them, and more than one component among all of theirs.
    told = scratch.cut(found.of(found.of(stars, "rep", "label"), "lead", "of_lead").select("lead", "rep", "label", (F.col("label") != F.col("of_lead")).alias("loose")), "told")
    spans = told.groupBy("lead").agg(F.count("*").alias("k"), F.max("loose").alias("any"), F.min("label").alias("low"), F.max("label").alias("high"))
    told = told.join(spans.where("any and k > 1 and low <> high").select("lead"), "lead", "left_semi")
    if not told.isEmpty():
        sets = scratch.cut(_sets(docs, told.select("rep").union(told.select("lead")), options), "sets")
        differences = scratch.cut(_listed(_differences(told, sets), options), "differences")
        own = scratch.cut(_held(differences.select("lead", "rep", F.explode("own").alias("token"))), "own-held")
        again_pairs = scratch.cut(_second_pairs(scratch.cut(_difference_entries(differences, own, options), "second-entries"), options), "second-pairs")
        scratch.drop("differences", "own-held", "second-entries")
        add(again_pairs, "second", sets)
        scratch.drop("sets", "second-pairs")
    scratch.drop("stars", "told")

    named = rows.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    if again is not None:
        # A document with several texts connects the classes of all of them.
        ends = rows.where("n_shingles > 0").join(named, ["f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        ends = _only(ends, "b", again, options).unionByName(_only(ends, "a", again, options)).where("a <> b").distinct()
        if not ends.isEmpty():
            found.add(ends)
    named = found.of(named, "rep", "component").select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "component")
    out = rows.join(named, (rows["f1"] == named["_f1"]) & (rows["f2"] == named["_f2"]) & (rows["n_shingles"] > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, options: JaccardJoin = JaccardJoin()) -> DataFrame:
    """The rows, all columns, of one document of each component, the one with the smallest id. Rows that repeat a
    doc_id count as one document and one of them stays; rows without a doc_id stay."""
    scratch = Scratch(docs.sparkSession, "jaccard-kept")
    links = scratch.cut(link(docs, options), "links")
    kept = _only(docs, "doc_id", links.where("doc_id <> component_id").select("doc_id"), options, "left_anti")
    again = links.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = _only(kept, "doc_id", again, options).dropDuplicates(["doc_id"])
    return _only(kept, "doc_id", again, options, "left_anti").unionByName(once)
