"""Interleaved document sequences: text and media in reading order, with payloads resolved by digest.

``parse`` turns HTML into an ordered list of segments: text, and references to media with the caption that belongs to
them (the figure's caption, else the alternative text). Positions count segments from 0, so text, references and
captions stay aligned. ``resolve`` joins the references to a store of payloads by digest; a reference whose
digest the store lacks keeps its place with null payload columns. ``store_texts`` makes a row for each distinct payload
with its media file, a grey picture with 8-bit samples (PNG, written here without loss); ``read_back`` reads the samples
of such files, and all payload columns are derived from those. ``pages_of`` makes the HTML that shows a payload.

Defined results: null or empty HTML is an empty sequence; broken HTML yields what its parser reads; equal payloads
share one row of the store; a null text is stored like the empty one.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import batches_of

WIDTH = 576
#: Media files are exchanged and stored, so their size is what the disk holds.
LEVEL = 6
PNG = b"\x89PNG\r\n\x1a\n"
DIGEST = re.compile(r"(?:^|[/:])([0-9a-f]{64})(?:\.\w+)?$")
SEGMENT = "position int, kind string, text string, src string, digest string, caption string"
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "br", "section", "article", "figure", "blockquote", "pre", "title"}
HIDDEN = {"script", "style", "noscript", "template"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class Sequence(HTMLParser):
    """Segments in reading order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.segments: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figure: int | None = None  # first segment of the open figure
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self._add(kind="text", text=text)

    def _add(self, **fields) -> None:
        self.segments.append({"position": len(self.segments), "kind": None, "text": None, "src": None, "digest": None, "caption": None} | fields)

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self._flush()
        if tag == "figure":
            self.figure = len(self.segments)
        elif tag == "figcaption":
            self._flush()
            self.caption = []
        elif tag in MEDIA:
            own = dict(attrs)
            src = own.get("src")
            if src:
                self._flush()
                found = DIGEST.search(src)
                self._add(kind="media", src=src, digest=found and found[1], caption=own.get("alt") or None)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for segment in self.segments[self.figure or 0 :] if self.figure is not None else []:
                if segment["kind"] == "media" and caption:
                    segment["caption"] = caption
        elif tag == "figure":
            self._flush()
            self.figure = None
        if tag in BLOCKS:
            self._flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)

    def done(self) -> list[dict]:
        self.close()
        self._flush()
        return self.segments


def sequence(html: str | None) -> list[dict]:
    parser = Sequence()
    if html:
        parser.feed(html)
    return parser.done()


def parse(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, segments: array of structs in reading order."""

    def run(batches):
        kind = pa.list_(pa.struct([("position", pa.int32())] + [(n, pa.string()) for n in ("kind", "text", "src", "digest", "caption")]))
        for rows in batches_of(batches, [key, html]):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([sequence(r[1]) for r in rows], kind)], names=[key, "segments"])

    fields = ",".join(f.replace(" ", ":") for f in SEGMENT.split(", "))
    return pages.select(F.col(key).cast("long").alias(key), html).mapInArrow(run, f"{key} long, segments array<struct<{fields}>>")


def references(parsed: DataFrame, key: str) -> DataFrame:
    """One row per media reference, with the text segments just before and after it."""
    near = lambda at: F.when(F.get("segments", at)["kind"] == "text", F.get("segments", at)["text"])
    media = F.filter("segments", lambda s: s["kind"] == "media")
    row = parsed.select(key, "segments", F.explode(media).alias("m"))
    return row.select(key, "m.position", "m.src", "m.digest", "m.caption", near(F.col("m.position") - 1).alias("before"), near(F.col("m.position") + 1).alias("after"))


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """The references with the columns of the store, which has one row per digest. Copies of a payload make its digest
    a frequent key, but of references only: rows of a few hundred bytes that adaptive execution splits."""
    return refs.join(store, "digest", "left")


# Payloads ----------------------------------------------------------------------------------------------------


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled with 255 to a positive multiple of the width, and their number before that."""
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % WIDTH if data else WIDTH), len(data)


def write_png(samples: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit picture; each line unfiltered."""
    height = len(samples) // width
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, width)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def read_png(media: bytes) -> tuple[bytes, int, int]:
    """Samples, width and height of an 8-bit grey picture with unfiltered lines; chunk checksums are verified."""
    if media[:8] != PNG:
        raise ValueError("not a PNG file")
    at, body, size = 8, [], (0, 0)
    while at < len(media):
        (length,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + length)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", data[:8])
            if data[8:] != bytes([8, 0, 0, 0, 0]):
                raise ValueError("not an 8-bit grey picture")
        elif kind == b"IDAT":
            body.append(data)
        at += length + 12
    width, height = size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes(), width, height


def feature(samples: bytes, width: int, height: int) -> str:
    """Size, mean, deviation and shares of the sixteen ranges of sample values."""
    values = np.frombuffer(samples, np.uint8)
    shares = np.bincount(values >> 4, minlength=16) * 1000 // len(values)
    mean = int(values.sum(dtype=np.int64)) / len(values)
    square = int((values.astype(np.int64) ** 2).sum()) / len(values)
    return f"{width}x{height};mean={mean:.4f};sd={max(0.0, square - mean * mean) ** 0.5:.4f};" + "-".join(map(str, shares))


STORED = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def store_texts(docs: DataFrame) -> DataFrame:
    """digest of the payload, media: a row for each distinct payload."""

    def run(batches):
        for rows in batches_of(batches, ["text"]):
            payloads = [payload_of(text)[0] for (text,) in rows]
            columns = [pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([write_png(p) for p in payloads], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "media"])

    return docs.select("text").mapInArrow(run, "digest string, media binary").dropDuplicates(["digest"])


def read_back(store: DataFrame) -> DataFrame:
    """digest, and what reading the media file gives. UTF-8 has no byte 255, so those at the end are filling."""

    def run(batches):
        for rows in batches_of(batches, ["digest", "media"]):
            out = []
            for digest, media in rows:
                back, width, height = read_png(media)
                out.append((digest, len(back.rstrip(b"\xff")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, width, height)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["digest", *STORED])

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.select("digest", "media").mapInArrow(run, schema)


def pages_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, html: the whole text, and the picture of its payload."""

    def run(batches):
        for rows in batches_of(batches, [key, "text"]):
            out = []
            for _, text in rows:
                payload, n = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                out.append(f'<article><p>{escape(text or "")}</p><figure><img src="media/{digest}.png" alt=""><figcaption>{n} bytes</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(out, pa.string())], names=[key, "html"])

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, html string")


def document_media(docs: DataFrame, scratch) -> DataFrame:
    """Every document's stored form, reached as a reader would: its HTML is parsed, the reference's digest joined to what
    reading the store of distinct payloads back gives. ``scratch`` takes the store, media files included."""
    store = read_back(scratch.cut(store_texts(docs), "store"))
    refs = references(parse(pages_of(docs), "doc_id"), "doc_id").select("doc_id", "digest", "position", "caption")
    return resolve(refs, store).select("doc_id", *STORED, "position", "caption")
