"""Media columns: interleaved document sequences with digest-addressed payloads.

A page is parsed into an ordered array of elements: text segments, and media
references with a digest and a caption.  Payloads live in a store, a table of
(digest, media), and are resolved by a join on the digest: the store is read
back, each payload decoded and described next to its bytes, and only the narrow
descriptions are shuffled to the references, so positions and captions stay
aligned and no payload travels.

The query over documents renders each text as such a page, with the UTF-8 text
itself, padded with bytes 255 to a multiple of 576, as an 8-bit greyscale image
of 576 columns in a PNG file.

Memory is bounded by one Arrow batch of whole texts and one payload; a very long
text is a batch of its own.  A batch stores a payload only once, and digests that
several batches store are described alike.  References to a hot digest meet one
description, written first, so the join may split them.

Defined cases: null is the empty text; the empty text has one row of padding;
repeated rows and equal texts share payloads and values; pages without media
have text elements alone, pages with several have a reference for each, in
order; references whose digest the store lacks stay with null descriptions; rows
with no or one id are described each by its own text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import struct
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, checkpoint_dir, cut, delete, table, text_batches

COLUMNS = 576
SCHEME = "sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ELEMENTS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_MEDIA = {"img", "video", "audio", "source", "embed"}
_HIDDEN = {"script", "style", "template", "noscript"}
_BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "br", "hr", "nav", "figure", "figcaption", "header", "footer", "main", "aside", "blockquote", "pre", "title", "body", "head", "html"}


class SequenceParser(HTMLParser):
    """Collects (kind, text, digest or address, caption) in document order; text of one block joins up exactly as written."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self._text: list[str] = []
        self._hidden = 0
        self._figure: list[int] | None = None
        self._caption: list[str] | None = None

    def _flush(self) -> None:
        text = "".join(self._text)
        self._text.clear()
        if text.strip():
            self.elements.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self._hidden += 1
        elif tag in _MEDIA:
            told = dict(attrs)
            if told.get("src"):
                self._flush()
                self.elements.append(["media", None, told["src"].removeprefix(SCHEME), told.get("alt") or None])
                if self._figure is not None:
                    self._figure.append(len(self.elements) - 1)
        elif tag in _BLOCKS:
            self._flush()
            if tag == "figure":
                self._figure = []
            elif tag == "figcaption" and self._figure is not None:
                self._caption = []

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in _HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self._hidden = max(self._hidden - 1, 0)
        elif tag in _BLOCKS:
            if tag == "figcaption" and self._caption is not None:
                caption = " ".join("".join(self._caption).split())
                for at in self._figure or ():
                    self.elements[at][3] = caption
                self._caption = None
            elif tag == "figure":
                self._figure = None
            self._flush()

    def handle_data(self, data: str) -> None:
        if self._hidden:
            return
        (self._text if self._caption is None else self._caption).append(data)


def parse_sequence(page: str | None) -> list[dict]:
    """The ordered elements of one HTML page."""
    parser = SequenceParser()
    parser.feed(page or "")
    parser.close()
    parser._flush()
    return [{"pos": k, "kind": e[0], "text": e[1], "digest": e[2], "caption": e[3]} for k, e in enumerate(parser.elements)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, elements) for each row of pages."""

    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        elements = pa.array([parse_sequence(p) for p in batch.column("html").to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([batch.column("id"), elements], names=[id_col, "elements"])

    return arrow_map(pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")), of, f"`{id_col}` long, elements {ELEMENTS}")


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (COLUMNS - len(data) % COLUMNS if len(data) % COLUMNS or not data else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG of COLUMNS columns with the payload's bytes as samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    plain = np.zeros((len(rows), COLUMNS + 1), np.uint8)
    plain[:, 1:] = rows
    head = struct.pack(">IIBBBBB", COLUMNS, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG as to_png writes it; raises ValueError on damage or another format."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, head = 8, [], None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(head[1], head[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered PNG rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit difference hash of 8 bands of the image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    counts = np.bincount(rows.ravel(), minlength=256)
    share = counts / counts.sum()
    mean = float((share * np.arange(256)).sum())
    deviation = float(np.sqrt((share * (np.arange(256) - mean) ** 2).sum()))
    used = share[share > 0]
    entropy = float(-(used * np.log2(used)).sum())
    edges = [len(rows) * k // 8 for k in range(9)]
    bands = np.stack([rows[a : max(b, a + 1)].sum(axis=0, dtype=np.int64).reshape(9, COLUMNS // 9).sum(axis=1) / max(b - a, 1) for a, b in zip(edges, edges[1:], strict=False)])
    bits = np.packbits(bands[:, 1:] > bands[:, :-1])
    return f"{mean:.4f}:{deviation:.4f}:{entropy:.4f}:{bits.tobytes().hex()}"


def store_payloads(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store (digest, n_bytes, media) of the texts' payloads to path, each digest once a batch."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        stored: set[bytes] = set()
        rows = []
        for text in batch.column("text").to_pylist():
            payload = payload_of(text)
            digest = hashlib.sha256(payload)
            if digest.digest() not in stored:
                stored.add(digest.digest())
                rows.append((digest.hexdigest(), len((text or "").encode("utf-8", "surrogatepass")), to_png(payload)))
        kinds = (pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["digest", "n_bytes", "media"])

    stored = arrow_map(docs.select(F.col(text_col).alias("text")), of, "digest string, n_bytes long, media binary")
    stored.write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def describe_store(store: DataFrame) -> DataFrame:
    """One row for each digest of a store: what reading its stored bytes back gives."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for digest, n_bytes, media in zip(frame["digest"], frame["n_bytes"], frame["media"], strict=True):
                payload = from_png(media)
                rows.append((digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            yield pd.DataFrame(rows, columns=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = text_batches(store).select("digest", "n_bytes", "media").mapInPandas(batches, schema)
    return rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in rows.columns if c != "digest"))


def resolve(elements: DataFrame, described: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, pos, caption, digest, what described says of it): a row for each media reference of each sequence."""
    refs = elements.select(id_col, F.explode("elements").alias("e")).where("e.kind = 'media'").select(id_col, "e.pos", "e.caption", "e.digest")
    return refs.join(described, "digest", "left")


def outline(elements: Column) -> Column:
    """A sequence as an array of (pos, kind, digest, caption) in order: media by their digest, text by the SHA-256 of its UTF-8."""
    own = lambda e: F.struct(e["pos"].alias("pos"), e["kind"].alias("kind"), F.coalesce(e["digest"], F.sha2(e["text"].cast("binary"), 256)).alias("digest"), e["caption"].alias("caption"))
    return F.transform(elements, own)


def pages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, html): each text as a page: its first line, a figure whose address is the digest of the text's payload, its other lines."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pages = []
        for text in batch.column("text").to_pylist():
            digest = hashlib.sha256(payload_of(text)).hexdigest()
            title = html.escape(" ".join((text or "").split(None, 8)[:8])[:80])
            first, *rest = (f"<p>{html.escape(x, quote=False)}</p>" for x in (text or "").split("\n"))
            pages.append(f'<article>{first}<figure><img src="{SCHEME}{digest}"><figcaption>{title}</figcaption></figure>{"".join(rest)}</article>')
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pages, pa.string())], names=["doc_id", "html"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), of, "doc_id long, html string")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: what its media reference resolves to, where it stands, and the outline of the whole sequence."""
    docs = table(spark, sf_dir, "documents")
    path = f"{checkpoint_dir(spark)}/media-{uuid.uuid4().hex}"
    store_payloads(docs, path)
    described = cut(describe_store(spark.read.parquet(path)))
    delete(spark, path)  # the query returns descriptions only
    elements = sequences(pages_of(docs), "doc_id").select("doc_id", outline(F.col("elements")).alias("sequence"))
    media = F.get(F.filter("sequence", lambda e: e["kind"] == "media"), F.lit(0))
    refs = elements.select("doc_id", "sequence", media["digest"].alias("digest"), media["caption"].alias("caption"), media["pos"].alias("media_pos"))
    joined = refs.join(described, "digest", "left")
    return joined.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption", "media_pos", "sequence")
