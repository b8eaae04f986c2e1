"""SentencePiece BPE encoding that keeps offsets, and its decoding.

The model file is read here (protocol-buffer wire format), without the library. Normalisation walks the text with
the compiled character map, a double-array trie over UTF-8 that is asked for the longest prefix it knows, and keeps
for each normalised byte the original byte it came from; merging then works on normalised text, and every piece
is projected back to a byte span of the original.

Speed: where the character map is empty and no piece has a character before a blank mark, text falls apart into
segments that no merge can cross. Each distinct segment is normalised, merged and aligned once per worker (a memo of
bounded size), and a text's spans are the running sums of its segments' own.

Defined results: null is encoded like the empty text (no ids, no spans); decoding ids gives the text that the library's
decode() gives; rows that repeat a doc_id, or have none, are encoded each; an empty table gives an empty result; texts of
any length are encoded whole. Only the key and the text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Memo, batches_of

MARK = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
NEVER = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie whose values point into a pool of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
        self.pool = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, start: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest known prefix of data[start:]."""
        units, found = self.units, None
        node = self._child(units[0])
        for at in range(start, len(data)):
            node ^= data[at]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[at]:
                break
            leaf = (unit >> 8) & 1
            node ^= self._child(unit)
            if leaf:
                begin = units[node] & 0x7FFFFFFF
                found = self.pool[begin : self.pool.index(0, begin)], at + 1 - start
        return found

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


@dataclass
class Model:
    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    charsmap: CharacterMap
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    merge: dict[str, float] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def read(data: bytes) -> Model:
        pieces, kinds, scores, options, trainer = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                options = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        if UNUSED in kinds or USER_DEFINED in kinds or trainer.get(24):
            raise ValueError("unused and user-defined pieces and blanks as suffixes are not supported")
        model = Model(
            pieces, kinds, scores, CharacterMap(options.get(2, b"")), bool(options.get(3, 1)), bool(options.get(4, 1)),
            bool(options.get(5, 1)), bool(trainer.get(35, 0)), trainer.get(44, " ⁇ ".encode()).decode(),
        )
        for i, piece in enumerate(pieces):
            if kinds[i] == NORMAL:
                model.ids[piece] = i
                model.merge[piece] = scores[i]
        return model


@dataclass(frozen=True)
class Piece:
    id: int
    text: str
    begin: int  # bytes of the original
    end: int


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        self.unk = model.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        inner = [p for p in model.ids if MARK in p.lstrip(MARK)]
        newline = any("\n" in p and len(p) > 1 for p in model.ids)
        plain = not model.charsmap and not model.remove_extra_whitespaces and model.escape_whitespaces
        self.splits = plain and not inner and not newline
        self.memo = Memo()
        # Nor can a merge cross the place between a letter and an ASCII mark if no piece has one after the other.
        marks = set(string.punctuation) - {b for p in model.ids for a, b in zip(p, p[1:]) if re.match(f"[{LETTERS}]", a)}
        own = "".join(map(re.escape, sorted(marks)))
        rest = f"[^{MARK}\n{LETTERS}]"  # no letters
        run = f"(?:[{LETTERS}]+(?:[^{MARK}\n{LETTERS}{own}]{rest}*)?)"  # letters, then no mark, and so on
        self.segments = re.compile(f"{MARK}+{rest}*{run}*|\n|{rest}+{run}*|{run}+").findall
        values = {i: b for b, i in self.byte_ids.items()}
        self.leads = np.array([i not in values or not 128 <= values[i] < 192 for i in range(len(model.pieces))])
        self.widths = np.array(
            [1 + sum(values[i] >= x for x in (192, 224, 240)) if i in values else len(p.encode()) - 2 * p.count(MARK) for i, p in enumerate(model.pieces)]
        )

    # Normalisation -------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its bytes, and its end, the original byte."""
        model, data = self.model, text.encode()
        out, origin, at = bytearray(), [], 0
        blank = MARK.encode() if model.escape_whitespaces else b" "

        def prefix(at: int) -> tuple[bytes, int]:
            known = model.charsmap.longest(data, at) if model.charsmap else None
            if known:
                return known
            size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
            return data[at : at + size], size

        if model.remove_extra_whitespaces:
            while at < len(data):
                new, size = prefix(at)
                if new.strip(b" "):
                    break
                at += size
        if at == len(data):
            return "", [at]
        if model.add_dummy_prefix:
            out += blank
            origin += [at] * len(blank)
        after_blank = model.remove_extra_whitespaces
        while at < len(data):
            new, size = prefix(at)
            if after_blank:
                new = new.lstrip(b" ")
            for byte in new:
                put = blank if byte == 32 else bytes([byte])
                out += put
                origin += [at] * len(put)
            if new:
                after_blank = model.remove_extra_whitespaces and new.endswith(b" ")
            at += size
        end = at
        if model.remove_extra_whitespaces:
            while out.endswith(blank):
                end = origin[len(out) - len(blank)]
                del out[-len(blank) :], origin[-len(blank) :]
        return out.decode(), [*origin, end]

    # Merging -------------------------------------------------------------------------------------------------

    def merged(self, segment: str) -> list[str]:
        """The best-scored neighbouring pair is merged first, the leftmost among equals, until none is known."""
        symbols, score = list(segment), self.model.merge.get
        if len(symbols) > 64:
            return self._merged_by_heap(symbols)
        pairs = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while pairs:
            best = max(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(symbols[i - 1] + symbols[i], NEVER)
            if i < len(pairs):
                pairs[i] = score(symbols[i] + symbols[i + 1], NEVER)
        return symbols

    def _merged_by_heap(self, symbols: list[str]) -> list[str]:
        scores, n = self.model.merge, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and (score := scores.get(both := symbols[left] + symbols[right])) is not None:
                heapq.heappush(heap, (-score, left, right, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def ids_of(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            known = self.model.ids.get(s)
            if known is not None:
                out.append(known)
            elif self.model.byte_fallback:
                out += [self.byte_ids[b] for b in s.encode()]
            else:
                out.append(self.unk)
        return out

    # Interface -----------------------------------------------------------------------------------------------

    def encode_spans(self, text: str | None) -> list[Piece]:
        """Every piece with its byte span in the original. Bytes of one character share that character's span."""
        normal, origin = self.normalise(text or "")
        out, at = [], 0
        parts = self.segments(normal) if self.splits else [normal] if normal else []
        for part in parts:
            for symbol in self.merged(part):
                end = at + len(symbol.encode())
                out += [Piece(i, self.model.pieces[i], origin[at], origin[end]) for i in self.ids_of([symbol])]
                at = end
        return out

    def encode_text(self, text: str | None) -> tuple[str, np.ndarray]:
        """The ids, in decimal, joined by commas, and the byte spans of the pieces in the original, a row each."""
        if not text or not self.splits or MARK in text:
            # A mark in the original is three bytes there, unlike one made from a blank.
            pieces = self.encode_spans(text)
            return ",".join(str(p.id) for p in pieces), np.array([(p.begin, p.end) for p in pieces], "<u4").reshape(-1, 2)
        memo = self.memo
        normal = text.replace(" ", MARK)
        parts = self.segments(MARK + normal if self.model.add_dummy_prefix else normal)
        try:
            ids = ",".join([memo[p] for p in parts])
        except KeyError:
            memo.trim()
            found = []
            for p in parts:
                own = memo.get(p)
                if own is None:
                    own = ",".join(map(str, self.ids_of(self.merged(p))))
                    memo.keep(p, own, 50 + len(own))
                found.append(own)
            ids = ",".join(found)
        return ids, self.spans(np.fromstring(ids, np.int64, sep=","))

    def spans(self, ids: np.ndarray) -> np.ndarray:
        """Byte spans in the original of a text that normalisation leaves as it is but for blanks: running sums of what each
        piece stands for. The first byte of a character stands for all of it, and its other bytes share its span."""
        width, lead = self.widths[ids], self.leads[ids]
        ends = np.cumsum(np.where(lead, width, 0))
        width = width[np.maximum.accumulate(np.where(lead, np.arange(len(ids)), 0))]
        begins = ends - width
        if self.model.add_dummy_prefix:  # the first mark stands for no byte
            ends, begins = ends - 1, np.maximum(begins - 1, 0)
        return np.stack([begins, ends], axis=1).astype("<u4")

    def decode(self, ids: list[int]) -> str:
        out, first, model = bytearray(), True, self.model
        for i in ids:
            kind = model.kinds[i]
            if kind == BYTE:
                out.append(int(model.pieces[i][3:5], 16))
            elif kind == UNKNOWN:
                out += model.unk_surface.encode()
            elif kind != CONTROL:
                piece = model.pieces[i]
                if first and model.add_dummy_prefix and piece.startswith(MARK):
                    piece = piece[1:]
                elif first and model.remove_extra_whitespaces:
                    piece = piece.lstrip(MARK)
                out += piece.replace(MARK, " ").encode()
            first = first and kind == CONTROL
        return out.decode(errors="replace")


class Decoder:
    """Decodes lists of ids written in decimal, each distinct id looked up once."""

    def __init__(self, encoder: Encoder):
        self.encoder, model = encoder, encoder.model
        self.bytes = {
            str(i): bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else model.unk_surface.encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for i, (p, k) in enumerate(zip(model.pieces, model.kinds))
        }

    def decode(self, ids: str) -> bytes:
        if not ids:
            return b""
        if not self.encoder.splits or not self.encoder.model.add_dummy_prefix:
            return self.encoder.decode(list(map(int, ids.split(",")))).encode()
        out = b"".join(map(self.bytes.__getitem__, ids.split(",")))
        return out[1:] if out.startswith(b" ") else out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(Model.read(f.read()))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pieces: array<struct<id, piece, begin, end>>."""

    def run(batches):
        model = encoder(path)
        for rows in batches_of(batches, [key, text], 1 << 20, model.memo):
            found = [[{"id": p.id, "piece": p.text, "begin": p.begin, "end": p.end} for p in model.encode_spans(r[1])] for r in rows]
            kind = pa.list_(pa.struct([("id", pa.int32()), ("piece", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(found, kind)], names=[key, "pieces"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, pieces array<struct<id:int,piece:string,begin:long,end:long>>")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256: the ids, the text decoded from them, and the byte spans
    (begin and end of each piece, little-endian unsigned 32-bit), digested where they are made, since the lists would be
    several times the table."""

    def run(batches):
        model = encoder(path)
        decoder = Decoder(model)
        for rows in batches_of(batches, ["doc_id", "text"], memo=model.memo):
            found = [model.encode_text(r[1]) for r in rows]
            ids = [f[0] for f in found]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
                 pa.array([sha(x.encode()) for x in ids], pa.string()), pa.array([sha(decoder.decode(x)) for x in ids], pa.string()),
                 pa.array([sha(f[1].tobytes()) for f in found], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
