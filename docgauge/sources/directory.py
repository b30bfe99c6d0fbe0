"""Directories of files as documents, with an optional provenance sidecar."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from functools import reduce
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..model import ADAPTER, DOCS, SIDECAR
from .lines import numbered
from .scratch import settled

BUNDLE_DIR = ".docgauge"
ADAPTER_NAME, ADAPTER_VERSION = "plaintext", "0.1.0"
MEDIA_TYPES = {".txt": "text/plain", ".md": "text/markdown"}
HEX64 = "^[0-9a-f]{64}$"
#: Names that a task lists at a time, files that a task reads, and bytes of contents that it holds (and one file's).
LISTED, FILES_A_TASK, HELD = 10_000, 8192, 4 << 20


class ProvenanceError(ValueError):
    """The sidecar can't be used; the message names the line or the locators."""


def now_iso() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _sidecar_rows(rows: DataFrame) -> DataFrame:
    """What is looked at of each line of a sidecar that isn't blank; bad tells whether it can't be used."""
    rows = rows.where(F.trim("value") != "")
    keys = rows.select("*", F.json_object_keys("value").alias("keys"), F.get_json_object("value", "$.locator").alias("locator"))
    unknown = keys.withColumn("unknown", F.array_except("keys", F.array(*[F.lit(x) for x in ("locator", *[f.name for f in SIDECAR])])))
    whole = F.try_parse_json("value").isNotNull() if hasattr(F, "try_parse_json") else F.col("keys").isNotNull()
    return unknown.withColumn("bad", ~whole | F.col("keys").isNull() | F.col("locator").isNull() | (F.size("unknown") > 0))


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """locator and the sidecar's fields, from a file or a folder of parts. Strict: any unusable line is an error that names it.

    Lines are numbered only to name one.
    """
    checked = _sidecar_rows(spark.read.text(str(path)))
    named = lambda r: f"{r['file'].removeprefix('file://') if Path(path).is_dir() else path}:{r['no']}"
    if checked.where("bad").limit(1).collect():
        r = _sidecar_rows(numbered(spark, str(path))).where("bad").orderBy("file", "no").first()
        try:
            what = "each entry is an object with a 'locator'" if not isinstance(e := json.loads(r["value"]), dict) or "locator" not in e else f"unknown field(s) {', '.join(sorted(r['unknown'] or []))}; allowed: {', '.join(f.name for f in SIDECAR)}"
        except json.JSONDecodeError as e:
            what = f"not JSON ({e.msg})"
        raise ProvenanceError(f"{named(r)}: {what}")
    if checked.groupBy("locator").count().where("count > 1").limit(1).collect():
        last = F.max(F.struct("file", "no")).alias("m")
        r = _sidecar_rows(numbered(spark, str(path))).groupBy("locator").agg(F.count(F.lit(1)).alias("n"), last).where("n > 1").orderBy("m").select("locator", "m.*").first()
        raise ProvenanceError(f"{named(r)}: locator {r['locator']!r} appears twice")
    return checked.select("locator", F.from_json("value", SIDECAR).alias("s")).select("locator", "s.*")


def _entries(root: bytes):
    """Lists folders where the task runs: path and whether it is a folder, for files and folders but the bundle's.

    A link to a folder is followed unless it leads to one that holds it.
    """

    def told(entry: os.DirEntry) -> bool | None:
        if entry.name == os.fsencode(BUNDLE_DIR):
            return None
        if entry.is_dir():
            return None if entry.is_symlink() and os.path.commonpath([real := os.path.realpath(entry.path), os.path.realpath(os.path.dirname(entry.path))]) == real else True
        return False if entry.is_file() else None

    def run(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with os.scandir(os.path.join(root, folder)) as found:
                    while entries := list(islice(found, LISTED)):
                        rows = [(os.path.join(folder, e.name), t) for e in entries if (t := told(e)) is not None]
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.bool_())], names=["path", "folder"])

    return run


def listed(spark: SparkSession, root: Path) -> tuple[DataFrame, int]:
    """path (bytes) and locator of every file below root, and how many there are.

    A round lists the folders of one depth on the executors, so the driver holds no names. The list is a checkpoint: it stays as it was made.
    """
    found, folders, n = [], spark.createDataFrame([(b"",)] if root.exists() else [], "path binary"), 1
    while n:
        dealt = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
        found.append(settled(dealt.mapInArrow(_entries(os.fsencode(root)), "path binary, folder boolean")))
        folders = found[-1].where("folder").select("path")
        n = folders.count()
    files = reduce(DataFrame.unionByName, found).where("NOT folder").select("path", tx.decode(F.col("path")).alias("locator"))
    return files, files.count()


def _contents(root: bytes):
    """Reads the files of each row's path where the task runs, some MB at a time; content comes after the other columns."""

    def run(batches):
        for batch in batches:
            first, held, size = 0, [], 0
            for k, path in enumerate(batch.column("path").to_pylist(), 1):
                with open(os.path.join(root, path), "rb") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= HELD or k == batch.num_rows:
                    rows = batch.slice(first, k - first)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], names=[*rows.schema.names, "content"])
                    first, held, size = k, [], 0

    return run


def read_directory(spark: SparkSession, root: str | Path, provenance: str | None = None) -> DataFrame:
    """Every regular file below root but the bundle's, as DOCS. The sidecar's locators must all exist.

    Names meet the sidecar and are dealt out before any file is read, so contents aren't moved.
    """
    base = Path(root).resolve()
    files, n = listed(spark, base)
    if provenance:
        side = read_sidecar(spark, provenance)
        lost = side.join(files.select("locator"), "locator", "left_anti").orderBy("locator").limit(20).collect()
        if lost:
            raise ProvenanceError(f"{provenance}: locator(s) not in the corpus: {', '.join(r['locator'] for r in lost)}")
        files = files.join(side, "locator", "left")
    tasks = max(1, min(n, 2 * spark.sparkContext.defaultParallelism), n // FILES_A_TASK)
    shape = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    files = files.repartition(tasks).mapInArrow(_contents(os.fsencode(base)), shape)
    if not provenance:
        files = files.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in SIDECAR])
    suffix = F.regexp_extract(F.lower("locator"), r"(\.[a-z0-9]+)$", 1)
    by_suffix = F.lit(None).cast("string")
    for k, v in MEDIA_TYPES.items():
        by_suffix = F.when(suffix == k, v).otherwise(by_suffix)
    docs = files.select(
        F.sha2("content", 256).alias("doc_hash"), tx.decode(F.col("content")).alias("text"), F.octet_length("content").cast("long").alias("size_bytes"),
        F.coalesce("source_system", F.lit("fs")).alias("source_system"), F.col("locator").alias("source_locator"), "source_id", "collected_at",
        F.coalesce("media_type", by_suffix).alias("media_type"), F.lit(now_iso()).alias("ingested_at"), "custody", "markings", "parent_hash", "reliability",
        F.struct(F.lit(ADAPTER_NAME).alias("name"), F.lit(ADAPTER_VERSION).alias("version"), F.lit(None).cast("double").alias("extraction_confidence"), F.lit(None).cast("string").alias("path")).cast(ADAPTER).alias("adapter"),
    )
    return docs.select(*[f.name for f in DOCS])


def problems(docs: DataFrame) -> DataFrame:
    """Documents whose envelope breaks its schema, with the field that does."""
    fine = lambda c: F.coalesce(c, F.lit(True))
    checks = {
        "doc_hash": F.coalesce(F.col("doc_hash").rlike(HEX64), F.lit(False)),
        "size_bytes": F.coalesce(F.col("size_bytes") >= 0, F.lit(False)),
        "source_system": F.col("source_system").isNotNull(),
        "source_locator": F.col("source_locator").isNotNull(),
        "ingested_at": F.col("ingested_at").isNotNull(),
        "adapter": F.col("adapter.name").isNotNull() & F.col("adapter.version").isNotNull(),
        "parent_hash": fine(F.col("parent_hash").rlike(HEX64)),
        "reliability/source": fine(F.col("reliability.source").isin(*"ABCDEF")),
        "reliability/information": fine(F.col("reliability.information").isin(*"123456")),
        "custody": fine(F.forall("custody", lambda x: x["actor"].isNotNull() & x["at"].isNotNull())),
    }
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return docs.select("source_locator", broken.alias("fields")).where(F.size("fields") > 0)


def validate(docs: DataFrame) -> DataFrame:
    """docs, or ProvenanceError with the first broken envelopes."""
    bad = problems(docs).orderBy("source_locator").limit(5).collect()
    if bad:
        raise ProvenanceError("; ".join(f"{r['source_locator']}: bad {', '.join(r['fields'])}" for r in bad))
    return docs
