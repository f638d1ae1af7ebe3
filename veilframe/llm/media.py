"""Interleaved document sequences with media columns.

HTML is parsed into an ordered array of structs: runs of text and references to media, each with its position; a reference in a
figure keeps the figure's caption. Media payloads are stored once encoded, as 8-bit grey PNG images (lossless), in a written
table keyed by the sha256 of the payload; what a reference needs of its payload is read back from the stored bytes and joined by
digest, so positions and captions stay aligned with what they point to.

``sequences_of`` gives whole sequences, runs of text and resolved references in their order, of any pages.

Scale: payloads are never shuffled; only digests and features are joined, as two written tables, so that Spark's skew join can split
a digest that a third of all rows share. A worker stores equal payloads of a block once. The query over documents keeps of
each text run its place and length, as the text itself stands in the documents. Results: a null text counts
as empty and gives 64 zero bytes; equal payloads give equal stored bytes and values; a reference without stored payload keeps
its place with null features; pages of equal id are told apart by their html, equal ones by nothing but their number; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, ids_and_texts, in_slices, spark_schema

UNIT = 64
SCHEME = "media:"
_TAG = re.compile(r"<!--.*?-->|<![^>]*>|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements that hold media, and elements that end a run of text.
MEDIA_TAGS = frozenset({"img", "video", "audio", "source", "embed"})
BLOCK_TAGS = frozenset("p div section article figure figcaption li ul ol table tr td th h1 h2 h3 h4 h5 h6 br hr body header footer main nav aside pre blockquote".split())
SILENT_TAGS = frozenset({"script", "style", "head", "title", "noscript", "template"})

SEQUENCE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())]))


def interleave(page: str | None) -> list[dict]:
    """The ordered sequence of a page: dicts of position, kind (text or media), text, reference, caption."""
    out: list[dict] = []
    run: list[str] = []
    silent, figure, in_caption = "", [], False
    caption: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append({"position": len(out), "kind": "text", "text": text, "reference": None, "caption": None})

    def caption_done() -> None:
        nonlocal in_caption
        text = " ".join(html.unescape("".join(caption)).split())
        caption.clear()
        in_caption = False
        for i in figure:
            out[i]["caption"] = text or out[i]["caption"]

    last, page = 0, page or ""
    for m in _TAG.finditer(page):
        if not silent:
            (caption if in_caption else run).append(page[last : m.start()])
        last = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if silent:
            if closing and name == silent:
                silent = ""
            continue
        if name in SILENT_TAGS and not closing:
            silent = "" if m[3].endswith("/") else name
        elif name == "figcaption":
            flush()
            if closing:
                caption_done()
            else:
                in_caption = True
        elif name == "figure":
            flush()
            if in_caption:
                caption_done()
            figure = []
        elif name in MEDIA_TAGS and not closing:
            flush()
            given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])}
            if given.get("src"):
                figure.append(len(out))
                out.append({"position": len(out), "kind": "media", "text": None, "reference": given["src"], "caption": given.get("alt") or None})
        elif name in BLOCK_TAGS:
            flush()
    if not silent:
        (caption if in_caption else run).append(page[last:])
    if in_caption:
        caption_done()
    flush()
    return out


# ---- payloads ------------------------------------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 4) -> bytes:
    """An 8-bit grey image, UNIT samples wide, without filters."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of an image as ``to_png`` writes it; damaged bytes raise ValueError."""
    if stored[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, size = 8, b"", (0, 0)
    while at < len(stored):
        n = struct.unpack_from(">I", stored, at)[0]
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a filter is used")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and the shares of sixteen ranges of the samples."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = float((counts * values).sum() / n)
    deviation = float(np.sqrt((counts * (values - mean) ** 2).sum() / n))
    return f"{mean:.4f};{deviation:.4f};" + ",".join(f"{x / n:.4f}" for x in counts.reshape(16, 16).sum(axis=1).tolist())


FEATURES = pa.schema(
    [("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def read_back(store: DataFrame) -> DataFrame:
    """``store``: digest, media. A row for each digest, from the stored bytes alone; wrong digests raise. Callers write it down
    before they join it, so that both sides of the join are plain exchanges."""

    def run(batches):
        for b in in_slices(batches):
            rows = []
            for digest, stored in zip(b.column("digest").to_pylist(), b.column("media").to_pylist()):
                payload = from_png(stored)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest:
                    raise ValueError("a payload does not have its digest")
                rows.append((digest, len(payload), sha, zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            if rows:
                yield batch(FEATURES, **dict(zip(FEATURES.names, map(list, zip(*rows)))))

    return store.select("digest", "media").mapInArrow(run, spark_schema(FEATURES)).groupBy("digest").agg(*(F.min(c).alias(c) for c in FEATURES.names[1:]))


def resolve(sequences: DataFrame, features: DataFrame) -> DataFrame:
    """``sequences``: rows with ``sequence`` (see interleave). A row for each media reference, with the row's other columns,
    position, reference, caption, and the features of the payload whose digest the reference names (null without one)."""
    others = [c for c in sequences.columns if c != "sequence"]
    each = sequences.select(*others, F.explode(F.filter("sequence", lambda s: s["kind"] == "media")).alias("part"))
    each = each.select(*others, F.col("part.position").alias("position"), F.col("part.reference").alias("reference"), F.col("part.caption").alias("caption"))
    named = each.withColumn("named", F.when(F.startswith("reference", F.lit(SCHEME)), F.substring("reference", len(SCHEME) + 1, 64)))
    return named.join(features.withColumnRenamed("digest", "stored"), F.col("named") == F.col("stored"), "left").drop("stored").withColumnRenamed("named", "digest")


def parse_pages(pages: DataFrame, *more: str | Column) -> DataFrame:
    """``pages``: page_id, html. The ordered sequence of each page: page_id, more columns of longs, sequence."""
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), *more, F.col("html").cast("string").alias("html"))
    names = light.columns[:-1]
    out = pa.schema([*((c, pa.int64()) for c in names), ("sequence", SEQUENCE)])

    def run(batches):
        for b in in_slices(batches):
            yield batch(out, sequence=[interleave(h) for h in b.column("html").to_pylist()], **{c: b.column(c) for c in names})

    return light.mapInArrow(run, spark_schema(out))


def sequences_of(pages: DataFrame, features: DataFrame) -> DataFrame:
    """``pages``: page_id, html. The whole sequence of each page, its references with their payload's features (see FEATURES; null
    without stored payload): page_id, n (how many equal pages), sequence."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    mark = F.xxhash64("html").alias("mark")
    each = parse_pages(named.groupBy("page_id", "html").agg(F.count(F.lit(1)).alias("n")), "n", mark)
    apart = each.select("page_id", "mark", "n", F.explode_outer("sequence").alias("part"))
    digest = F.when(F.startswith("part.reference", F.lit(SCHEME)), F.substring("part.reference", len(SCHEME) + 1, 64))
    joined = apart.withColumn("named", digest).join(features, F.col("named") == F.col("digest"), "left")
    element = F.struct("part.*", *(c for c in features.columns if c != "digest"))
    whole = joined.groupBy("page_id", "mark", "n").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), element))).alias("sequence"))
    return whole.select("page_id", "n", "sequence")


def page_of(text: str, digest: str) -> str:
    """A page that shows a text and, in a figure, its media form."""
    return f'<article><p>{html.escape(text, quote=False)}</p><figure><img src="{SCHEME}{digest}" alt="payload"><figcaption>{len(text)} code points</figcaption></figure></article>'


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_runs", pa.int64()), ("text_chars", pa.int64()), ("sequence", SEQUENCE), ("digest", pa.string()), ("media", pa.binary())])


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text as a page with its media form: doc_id, n_bytes, how many text runs the page has and their code points, the
    page's sequence without the texts, digest, media (null where the block holds the same payload already)."""

    def run(batches):
        for b in in_slices(batches):
            known: set[str] = set()
            columns: dict[str, list] = {f: [] for f in STORED.names}
            columns["doc_id"] = b.column("doc_id").to_pylist()
            for text in b.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                payload = padded(raw)
                digest = hashlib.sha256(payload).hexdigest()
                sequence = interleave(page_of(text or "", digest))
                runs = [len(s["text"]) for s in sequence if s["kind"] == "text"]
                for name, value in (("n_bytes", len(raw)), ("text_runs", len(runs)), ("text_chars", sum(runs)), ("sequence", [s | {"text": None} for s in sequence]), ("digest", digest)):
                    columns[name].append(value)
                columns["media"].append(None if digest in known else to_png(payload))
                known.add(digest)
            yield batch(STORED, **columns)

    return ids_and_texts(docs).mapInArrow(run, spark_schema(STORED))


def media_features(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The contract's columns, one row a document, from what was stored and read back; text_runs and text_chars of its page, and
    position and caption of the reference to its payload."""
    store = scratch.save(store_texts(docs), "media")
    features = scratch.save(read_back(store.where("media IS NOT NULL")), "features")
    shown = resolve(store.select("doc_id", "n_bytes", "text_runs", "text_chars", "sequence"), features)
    return shown.select("doc_id", "n_bytes", *FEATURES.names[1:], "text_runs", "text_chars", "position", "caption")
