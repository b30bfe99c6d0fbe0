"""Media columns: interleaved sequences of text and media references, payloads resolved by digest.

html_segments() turns a page into an ordered array of segments: text, or a media reference
with its digest and caption. store_media() keeps payloads losslessly as 8-bit grey PNG
images (padded with byte 255, which UTF-8 never uses, to rows of ROW_BYTES samples) in a table keyed by the
digest of the unpadded payload. read_media() reads the stored bytes back and computes
features; interleave() joins the two by digest and keeps positions and captions aligned.

Defined cases: a null payload is empty and stored as one row of padding; equal payloads
have equal digests, bytes and features; a reference whose digest is unknown keeps its
place with null media columns; broken HTML gives what the parser could read, and tags that are never closed
lose no text; null HTML gives no segments; very long texts and pages are taken whole; repeated rows have sequences of their
own; columns of the input may have any name; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, discard, packed, pin, read, scratch, text_of
from .memory import tidy

ROW_BYTES = 576
REF = "media:sha256:"
SEGMENT = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
MEDIA = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ZLIB_LEVEL = 1


# --- the stored form -------------------------------------------------------


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of ROW_BYTES."""
    return data + b"\xff" * (-len(data) % ROW_BYTES if data else ROW_BYTES)


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG whose rows are the payload's; payload is a positive multiple of ROW_BYTES."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    lines = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)  # each row begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW_BYTES, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), ZLIB_LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The payload of to_png(); every chunk's checksum is verified."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Size, mean, deviation and entropy of the samples, and an average hash of 8 x 8 cells."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    level = np.arange(256)
    mean = float((counts * level).sum() / len(x))
    dev = float(np.sqrt(max(0.0, (counts * level.astype("f8") ** 2).sum() / len(x) - mean * mean)))
    cells = np.add.reduceat(x.astype("u4"), np.arange(64) * len(x) // 64)
    bits = (cells > np.median(cells)).astype(int)
    return f"gray8 {ROW_BYTES}x{len(x) // ROW_BYTES} mean={mean:.4f} dev={dev:.4f} entropy={-(share * np.log2(share)).sum():.4f} ahash={int(''.join(map(str, bits)), 2):016x}"


def _encode(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            texts = [t.encode("utf-8") for t in batch.slice(k, 256).column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([to_png(padded(t)) for t in texts], pa.binary())], names=["digest", "media"]
            )


def _decode(batches):
    names = [c.split()[0] for c in MEDIA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        cols = [[] for _ in names]
        for digest, media in zip(batch.column(0), batch.column(1)):
            stored = media.as_buffer().to_pybytes()
            payload = from_png(stored)
            n = len(payload.rstrip(b"\xff"))
            row = (digest.as_py(), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload))
            for c, v in zip(cols, row):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def store_media(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """Write (digest, media) for every row; equal payloads give equal rows."""
    arrow_limits(docs.sparkSession)
    docs.select(text_of(text_col).alias("text")).mapInArrow(tidy(_encode), "digest string, media binary").write.option("compression", "uncompressed").parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """The media's columns, computed from the stored bytes; one row per digest."""
    return spark.read.parquet(path).select("digest", "media").mapInArrow(tidy(_decode), MEDIA).dropDuplicates(["digest"])


# --- sequences -------------------------------------------------------------


class _Segments(HTMLParser):
    """Collects text and media in order; the figcaption of a figure, else alt, is the caption.

    What stands in an element that isn't shown is taken back when that element ends. If it never ends, or an
    element around it ends first, its tag was stray and its text stays.
    """

    HIDDEN = {"script", "style", "template", "noscript"}
    AROUND = {"div", "article", "section", "figure", "body", "li", "td", "table", "ul", "ol"}
    BREAKS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "title", "figcaption"} | AROUND
    #: A caption holds none of these, so one that isn't closed ends here.
    PAST_CAPTION = {"article", "section", "body", "figure", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6"}
    MEDIA = {"img", "audio", "video", "source"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.around = [], [], []
        self.hidden: list[tuple] = []  # tag, how many segments and pieces of text stood before it, how many elements were around it
        self.figure = self.caption = None  # where the figure began; where its caption began, and its text

    def cut(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.append(["text", text, None, None])

    def end_caption(self):
        """What was collected since the caption began is its text."""
        if self.caption is not None and self.caption[1] is None:
            self.cut()
            at = self.caption[0]
            mine = [x for x in self.out[at:] if x[0] == "text"]
            self.out[at:] = [x for x in self.out[at:] if x[0] != "text"]
            self.caption = (at, " ".join(x[1] for x in mine))

    def end_figure(self):
        """The caption goes to every medium of the figure, before it or behind; without one it is text in its place."""
        self.end_caption()
        self.cut()
        if self.figure is not None and self.caption is not None and self.caption[1]:
            media = [x for x in self.out[self.figure :] if x[0] == "media"]
            for x in media:
                x[3] = self.caption[1]
            if not media:
                self.out.insert(self.caption[0], ["text", self.caption[1], None, None])
        self.figure = self.caption = None

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden.append((tag, len(self.out), list(self.held), len(self.around)))
            return
        if tag in self.PAST_CAPTION:
            self.end_caption()
        if tag in self.MEDIA:
            a = dict(attrs)
            self.cut()
            self.out.append(["media", None, _digest(a.get("src") or ""), a.get("alt")])
        elif tag in self.BREAKS:
            self.cut()
        if tag == "figure":
            self.end_figure()
            self.figure = len(self.out)
        elif tag == "figcaption" and self.figure is not None and self.caption is None:
            self.caption = (len(self.out), None)
        if tag in self.AROUND:
            self.around.append(tag)

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            for k in range(len(self.hidden) - 1, -1, -1):
                if self.hidden[k][0] == tag:
                    _, n, self.held, _ = self.hidden[k]
                    del self.out[n:], self.hidden[k:]
                    break
            return
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        if tag in self.BREAKS:
            self.cut()
        if tag in self.around:
            while self.around.pop() != tag:
                pass
            self.hidden = [x for x in self.hidden if x[3] <= len(self.around)]

    def handle_data(self, data):
        self.held.append(data)

    def finished(self):
        self.close()
        self.end_figure()
        self.cut()
        return self.out


def _digest(src: str) -> str | None:
    if src.startswith(REF):
        return src[len(REF) :].lower()
    if src.startswith("data:") and "," in src:
        head, _, body = src.partition(",")
        try:
            return hashlib.sha256(base64.b64decode(body) if head.endswith(";base64") else body.encode()).hexdigest()
        except ValueError:
            return None
    return None


def segments(html: str | None) -> list[dict]:
    """The page's segments in order."""
    parser = _Segments()
    parser.feed(html or "")
    return [{"position": k, "kind": a, "text": b, "digest": c, "caption": d} for k, (a, b, c, d) in enumerate(parser.finished())]


def html_segments(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """doc, the input's columns as a struct, and segments."""
    # The optimizer may not repeat a function that is not deterministic, so a page is parsed once whatever is asked of its segments.
    fn = F.pandas_udf(lambda s: s.map(segments), SEGMENT).asNondeterministic()
    return packed(pages, fn(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).alias("segments"))


def interleave(pages: DataFrame, media: DataFrame, id_col: str) -> DataFrame:
    """One row per segment: id, position, kind, text, digest, caption and the media's columns.

    Segments of text have a key of their own that no digest equals, so they are spread evenly. A digest that many
    pages refer to is hot only on this narrow side, which Spark may split; media has one row per digest.
    """
    flat = pages.select(F.col(f"doc.`{id_col}`").alias(id_col), F.explode("segments").alias("s")).select(id_col, "s.*")
    flat = flat.withColumn("__key", F.coalesce("digest", F.xxhash64(id_col, "position").cast("string")))
    known = media.withColumnRenamed("digest", "__digest")
    return flat.join(known, F.col("__key") == F.col("__digest"), "left").drop("__digest", "__key")


def sequences(rows: DataFrame, id_col: str) -> DataFrame:
    """interleave()'s rows gathered again: one ordered array of segments per page."""
    cols = [c for c in rows.columns if c not in (id_col, "position")]
    return rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("position", *cols))).alias("sequence"))


def _escaped(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def document_pages(docs: DataFrame) -> DataFrame:
    """A page for each document: its language, its text as a captioned figure, its source, and the source's name as a second medium.

    page is an id for each row, as doc_id may be missing or given twice.
    """
    ref = lambda text: F.concat(F.lit("<img src='" + REF), F.sha2(text.cast("binary"), 256), F.lit("'"))
    source = _escaped(F.col("source"))
    html = F.concat(
        F.lit("<article><h1>"), _escaped(F.col("lang")), F.lit("</h1><figure>"), ref(text_of()), F.lit("><figcaption>from "), source,
        F.lit("</figcaption></figure><p>source: "), source, F.lit("</p>"), ref(text_of("source")), F.lit(" alt='"), source, F.lit("'></article>"),
    )
    return docs.select("doc_id", html.alias("html")).withColumn("page", F.struct(F.monotonically_increasing_id().alias("row"), "doc_id"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as the first medium of a page, stored, read back, joined by digest and gathered into the page's sequence."""
    docs = read(spark, sf_dir, "documents")
    path = scratch(spark, "media")
    names = docs.select(text_of("source").alias("text")).distinct()
    store_media(docs.select("text").unionByName(names), path)
    media = pin(read_media(spark, path))
    discard(spark, path)
    told = sequences(interleave(html_segments(document_pages(docs)), media, "page"), "page")
    own = F.get(F.filter("sequence", lambda x: x["kind"] == "media"), F.lit(0))
    out = told.select("page.doc_id", own.alias("own"), F.size("sequence").alias("n_segments"), F.sha2(F.to_json("sequence").cast("binary"), 256).alias("sequence_sha256"))
    return out.select("doc_id", *[f"own.{c.split()[0]}" for c in MEDIA.split(", ")[1:]], "own.position", "own.caption", "n_segments", "sequence_sha256")
