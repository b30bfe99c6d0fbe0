"""WARC archives: write with an index, read back by coalesced byte ranges.

write_archives() writes gzip members, one per record, and returns the index: file, offset,
length, URL, digest and type of each record. A payload seen before (equal digest, at least
min_bytes long) becomes a revisit record that refers to the response with the smallest id.
read_archives() takes any selection of the index, groups it by file and block, sorts it,
merges neighbouring ranges and reads each merged range once.

Which digests repeat reaches the scan of the pages as a bitmap of bounded size; only pages
it marks meet their group, by shuffle, or in place where a group is a good part of all pages. A task attempt writes a file of its own name, and only
files in the pinned index are ever read, so a lost or repeated attempt does no harm.

Defined cases: null html is an empty payload, null urls are empty; payloads below min_bytes are responses;
repeated rows of the response's id are responses too; rows without an id can be responses only where
none of the group has one; line breaks in URLs are escaped;
very long payloads are written whole; other columns of the input are ignored, whatever their names; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_parts, join_counted, marked, pin, read, scratch, sketch
from .memory import tidy

FILE_BYTES = 256 << 20
BLOCK_BYTES = 8 << 20
GAP_BYTES = 64 << 10
LEVEL = 3
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _urn(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _of_urn(text: str | None) -> int | None:
    found = (text or "<urn:x-page:none>")[len("<urn:x-page:") : -1]
    return None if found == "none" else int(found)


def record(page_id, url: str, payload: bytes | None, n: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header alone as its block."""
    http = HTTP.format(n).encode()
    block = http + (payload or b"") if kind == "response" else http
    url = "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A record's columns as in RECORD; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    digest, kind, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], int(h["X-Payload-Length"])
    payload = None
    if kind == "response":
        payload = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")[2]
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != n:
            raise ValueError(f"record {h['WARC-Record-ID']} is damaged")
    refers = _of_urn(h["WARC-Refers-To"]) if kind == "revisit" else None
    return _of_urn(h["WARC-Record-ID"]), h["WARC-Target-URI"], n, digest, kind, refers, payload


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _writer(folder: str, file_bytes: int, level: int):
    def run(batches):
        store, root = _fs(folder)
        out, name, at, rows = None, "", 0, []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for r in batch.slice(k, 256).to_pylist():
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    payload = None if r["html"] is None else r["html"].encode("utf-8")
                    zipper = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = zipper.compress(record(r["page_id"], r["url"], payload, r["n"], digest, r["kind"], r["refers_to"])) + zipper.flush()
                    out.write(raw)
                    rows.append((f"{folder}/{name}", at, len(raw), r["page_id"], r["url"], digest, r["kind"]))
                    at += len(raw)
                yield _batch(rows, INDEX)
                rows = []
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write pages (page_id, url, html) below folder, a URI all executors reach; return the pinned index."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.sha1(payload).alias("sha1"), F.length(payload).cast("long").alias("n"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    groups = rows.where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    groups = pin(groups.select(F.col("sha1").alias("g"), "first", "c"))
    rows = marked(rows, F.xxhash64("sha1"), sketch(groups, F.xxhash64("g")), "again").withColumn("again", F.col("again") & (F.col("n") >= min_bytes))
    none = F.lit(None).cast("long")
    alone = rows.where("not again").select("page_id", "url", "sha1", "n", "html", F.lit("response").alias("kind"), none.alias("refers_to"))
    # Copies of a payload that very many pages have are decided where they are, and their html goes no further.
    met = join_counted(rows.where("again"), groups, "sha1", "g", "c", "left")
    revisit = F.col("g").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    met = met.select("page_id", "url", "sha1", "n", F.when(~revisit, F.col("html")).alias("html"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return pin(alone.unionByName(met).mapInArrow(tidy(_writer(folder, file_bytes, level)), INDEX))


def merged(ranges: list[tuple[int, int]], gap: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) as (start, end, members); ranges up to gap apart are read together."""
    out: list = []
    for offset, length in ranges:
        if out and offset - out[-1][1] <= gap:
            start, end, own = out[-1]
            own.append((offset, length))
            out[-1] = (start, max(end, offset + length), own)
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def _reader(gap: int, with_payload: bool):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                store, path = _fs(r["file"])
                with store.open_input_file(path) as f:
                    for start, end, members in merged([(x["offset"], x["length"]) for x in r["ranges"]], gap):
                        data, rows = f.read_at(end - start, start), []
                        for offset, length in members:
                            row = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                            rows.append(row if with_payload else (*row[:-1], None))
                        yield _batch(rows, RECORD)

    return run


def read_archives(index: DataFrame, block_bytes: int = BLOCK_BYTES, gap: int = GAP_BYTES, with_payload: bool = True, parts: int = 0) -> DataFrame:
    """The records that the rows of index name; a block's ranges are bounded by block_bytes."""
    one = F.struct("offset", "length")
    plan = index.groupBy("file", F.floor(F.col("offset") / block_bytes).alias("block")).agg(F.sort_array(F.collect_set(one)).alias("ranges"))
    # A row stands for a block to read: deal them out by number, as their own size says nothing.
    return plan.repartition(parts or input_parts(index), "file", "block").select("file", "ranges").mapInArrow(tidy(_reader(gap, with_payload)), RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(read(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: right('000' || bin(instr('0123456789abcdef', c) - 1), 4)), '') AS bits FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, (5 * i + j + 1)::INT, 1) AS INT) * (1 << (4 - j)::INT)))::INT, 1)), '') AS digest FROM b)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER w THEN NULL ELSE min(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY hex)
"""
