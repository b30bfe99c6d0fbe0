"""Registered queries over files: documents is written out as a directory, one file a row, and taken from there.

A document's file is <lang>/<doc_id>.md for even ids, .txt for others; labels gives the sidecar. Each
query states the same in SQL over the tables alone.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.directory import MEDIA_TYPES, listed, read_directory, validate
from ..sources.lines import numbered
from ..sources.scratch import shared_folder
from ..sources.tables import read_table
from ..streaming.score import FLAGS as STREAM_FLAGS
from ..streaming.score import flag_counts
from . import gate
from .bundle import RECORD, Origin, amend, build, derived, verify
from .inquiry import TOOLS, Bundle, play
from .ledger import Ledger
from .manifest import BundleFolder, Conclusion
from .queries import FLAG_SQL, MERKLE_SQL, PLAIN_SQL, TOKENS_SQL
from .signing import Signer

KEY = Signer(bytes(range(32)), "query")
FAMILIES = ["volume", "integrity"]
_LOCATOR = "coalesce(lang, 'none') || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END"


def _write(root: str):
    def run(batches):
        made = set()
        for rows in batches:
            for name, text in zip(*[c.to_pylist() for c in rows.columns]):
                path = f"{root}/{name}"
                if (folder := os.path.dirname(path)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(path, "wb") as f:
                    f.write(text)
            yield rows.select(["locator"])

    return run


def directory_of(spark: SparkSession, d: str, sidecar: bool = False) -> tuple[Path, Path | None]:
    """The documents as files below a new folder, and the labels as a sidecar beside it, a folder of parts."""
    root = shared_folder(spark, "corpus")
    docs = read_table(spark, d, "documents").select("doc_id", F.expr(_LOCATOR).alias("locator"), F.coalesce("text", F.lit("")).alias("text"))
    docs.select("locator", F.col("text").cast("binary")).mapInArrow(_write(str(root)), "locator string").agg(F.count("locator")).collect()
    if not sidecar:
        return root, None
    side = read_table(spark, d, "labels").join(docs.select("doc_id", "locator"), "doc_id").dropDuplicates(["locator"])
    entry = F.struct("locator", F.concat(F.lit("labels-"), "toxic").alias("source_system"), F.col("doc_id").cast("string").alias("source_id"), F.lit("2026-01-02").alias("collected_at"), F.struct(F.lit("B").alias("source")).alias("reliability"))
    path = shared_folder(spark, "sidecar") / "parts"
    side.select(F.to_json(entry).alias("value")).write.text(str(path))
    return root, path


def directory_scan(spark, d):
    """Every file with its hash, size, type and characters."""
    root, _ = directory_of(spark, d)
    return validate(read_directory(spark, root)).select("source_locator", "doc_hash", "size_bytes", "media_type", "source_system", F.length("text").cast("long").alias("chars"))


def sidecar_scan(spark, d):
    """Every file with what the sidecar says of it."""
    docs = validate(read_directory(spark, *directory_of(spark, d, sidecar=True)))
    return docs.select("source_locator", "source_system", "source_id", "collected_at", F.col("reliability.source").alias("reliability"))


def _built(spark, d) -> tuple[Path, dict]:
    root, _ = directory_of(spark, d)
    return root, build(root, read_directory(spark, root), Origin("documents", "1"), signers=[KEY], families=FAMILIES, parts=True)


def bundle_records(spark, d):
    """The records that a bundle holds, read back from its file."""
    root, _ = directory_of(spark, d)
    build(root, read_directory(spark, root), Origin("documents", "1"), signers=[KEY], families=FAMILIES, parts=True)
    if not (told := verify(spark, root, [KEY.verifier()])).ok:
        raise ValueError(f"the bundle does not verify: {told.checks}")
    rows = spark.read.json(str(BundleFolder(root).records))
    return rows.select("doc_hash", F.col("envelope.source_locator").alias("source_locator"), F.array_join(F.coalesce("flags", F.array().cast("array<string>")), ",").alias("flags"), F.col("metrics").getField("cnt.token_count").alias("tokens"))


def record_order(spark, d):
    """Where each record stands in a bundle's records: by hash, and then by the parts of its locator."""
    root, _ = directory_of(spark, d)
    build(root, read_directory(spark, root), Origin("documents", "1"), signers=[KEY], families=["volume"], policy=None, parts=True)
    rows = numbered(spark, str(BundleFolder(root).records), through=True)
    return rows.select(F.col("no").alias("place"), F.from_json("value", RECORD).alias("r")).select("place", "r.doc_hash", "r.envelope.source_locator")


def first_files(spark: SparkSession, root: Path, n: int) -> list[Path]:
    """The first n texts below root, by the parts of their paths. Executors list them, and the driver gets n names."""
    files, _ = listed(spark, root)
    texts = files.where(F.col("locator").rlike(f"({'|'.join(s.replace('.', '[.]') for s in MEDIA_TYPES)})$"))
    return [root / os.fsdecode(bytes(r["path"])) for r in texts.orderBy(F.split("locator", "/")).limit(n).collect()]


def bundle_checks(spark, d):
    """What a manifest says, the checks of verification, an amendment, and the differences after files were changed."""
    root, m = _built(spark, d)
    rows = [(k, str(m["corpus"][k])) for k in ("merkle_root", "document_count", "total_bytes", "hash_alg")] + [("records_count", str(m["records_count"])), ("policy", m["run"]["policy_version"])]
    rows += [(f"before: {k}", str(v)) for k, v in verify(spark, root, [KEY.verifier()], root).checks.items()]
    amended = amend(root, [Conclusion("INT-004", "real", approved_by="a person")], [], signers=[KEY], verifiers=[KEY.verifier()])
    rows += [("amended", next(f["assessment"] for f in amended["findings"] if f["finding_id"] == "INT-004"))]
    rows += [("other key", str(verify(spark, root, [Signer(bytes(32), "query").verifier()]).checks["signature"]))]
    files = first_files(spark, root, 2)
    files[0].write_text("changed")
    files[1].unlink()
    (root / "new.txt").write_text("new")
    after = verify(spark, root, [KEY.verifier()], root)
    rows += [("after: files", str(after.checks["corpus files match records"])), ("after: changed, added, removed", f"{len(after.changed)}, {len(after.added)}, {len(after.removed)}")]
    return spark.createDataFrame(rows, "name string, value string")


def investigation(spark, d):
    """What the tools say of the document with the smallest hash, and what becomes of proposals about a finding."""
    root, m = _built(spark, d)
    b, book = Bundle(spark, root, root), Ledger(spark, root)
    h = b.records.agg(F.min("doc_hash")).first()[0]
    record = b.call("get_record", {"doc_hash": h})[0]
    read = b.call("read_document", {"doc_hash": h, "max_chars": 50})[0]
    same = b.call("diff_documents", {"first": h, "second": h})[0]
    rows = [("findings", str(len(b.call("list_findings", {})[0]))), ("clause", b.call("get_finding", {"finding_id": "INT-004"})[0]["clause"]), ("locator", record["envelope"]["source_locator"])]
    rows += [("text", read["text"]), ("chars", str(read["of_chars"])), ("similarity", str(same["similarity"])), ("changes", str(len(same["changes"])))]
    bad = [("get_record", {"doc_hash": "0"}), ("propose", {"finding_id": "INT-004", "assessment": "real", "narrative": "n", "evidence": [], "status": "pass"}), ("no_tool", {})]
    rows += [("refused", str(sum(not b.call(*x)[1] for x in bad))), ("logged", str(len(b.log))), ("tools", ",".join(sorted(TOOLS)))]
    draft = {"finding_id": "INT-004", "assessment": "artifact", "narrative": "short by design", "evidence": [h]}
    first, second = (book.submit(play(Bundle(spark, root), turns)) for turns in ([[("propose", draft)]], [[]]))
    book.approve(first, "a person", [KEY], [KEY.verifier()])
    book.reject(second, "a person", "nothing in it")
    rows += [("states", ",".join(sorted(r["state"] for r in book.table().collect()))), ("assessment", next(f for f in BundleFolder(root).statement([KEY.verifier()]).predicate["findings"] if f["finding_id"] == "INT-004")["assessment"])]
    return spark.createDataFrame(rows, "name string, value string")


def derived_corpus(spark, d):
    """A corpus of the English documents alone, tied to the one it came from."""
    root, m = _built(spark, d)
    docs = read_directory(spark, root).where("source_locator LIKE 'en/%'")
    child = build(shared_folder(spark, "derived"), docs, Origin("documents", "2", derived(BundleFolder(root), "filter", "English")), signers=[KEY], families=["volume"], policy=None, parts=True)["corpus"]
    row = (child["derived_from"]["parent_merkle_root"], child["derived_from"]["relation"], child["document_count"], child["total_bytes"])
    return spark.createDataFrame([row], "parent_root string, relation string, document_count long, total_bytes long")


def stream_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Flags by hour of a stream of the documents; document n arrives n minutes after the new year."""
    rows = spark.readStream.schema(read_table(spark, d, "documents").schema).parquet(f"{d}/documents*.parquet")
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), F.timestamp_seconds(F.lit(1767225600) + F.col("doc_id") * 60).alias("at")).withColumn("size_bytes", F.octet_length("text").cast("long"))
    folder, name = shared_folder(spark, "stream"), "flags"
    run = flag_counts(rows, "at").writeStream.outputMode("complete").format("memory").queryName(f"{name}_{folder.name[-32:]}").option("checkpointLocation", folder.as_uri()).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(f"{name}_{folder.name[-32:]}").select(F.unix_seconds("start").alias("start"), F.col("docs"), F.col("tokens"), *STREAM_FLAGS)


FILE_QUERIES = {f.__name__: f for f in (directory_scan, sidecar_scan, bundle_records, record_order, bundle_checks, investigation, derived_corpus, stream_flag_counts)}

_DOCS = f"(SELECT *, {_LOCATOR.replace('STRING', 'VARCHAR')} AS locator, sha256(t) AS doc_hash FROM {PLAIN_SQL} p)"
_ROOT = f"(SELECT root FROM ({MERKLE_SQL}) z)"
_FLAG_NAMES = ("control_chars", "empty", "large", "markup_residue", "mojibake", "near_empty", "truncated")


def _values(pairs) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS name, CAST({v} AS VARCHAR) AS value" for k, v in pairs)


def _oracles() -> dict[str, str]:
    import yaml

    rules = yaml.safe_load(gate.DEFAULT_POLICY.read_text())["rules"]
    first = f"(SELECT {{0}} FROM {_DOCS} x ORDER BY doc_hash, string_split(locator, '/') LIMIT 1)"
    checks = ("signature", "manifest schema", "records hash", "records count", "merkle root", "statement subject", "corpus files match records")
    count, size = "(SELECT count(*) FROM documents)", f"(SELECT sum(strlen(t))::BIGINT FROM {PLAIN_SQL} p)"
    flags = ", ".join(f"CASE WHEN {FLAG_SQL[n]} THEN '{n}' END" for n in _FLAG_NAMES)
    return {
        "directory_scan": f"SELECT locator AS source_locator, doc_hash, strlen(t)::BIGINT AS size_bytes, CASE WHEN locator LIKE '%.md' THEN 'text/markdown' ELSE 'text/plain' END AS media_type, 'fs' AS source_system, length(t)::BIGINT AS chars FROM {_DOCS} x",
        "sidecar_scan": f"SELECT locator AS source_locator, CASE WHEN l.doc_id IS NULL THEN 'fs' ELSE 'labels-' || toxic END AS source_system, CAST(l.doc_id AS VARCHAR) AS source_id, CASE WHEN l.doc_id IS NOT NULL THEN '2026-01-02' END AS collected_at, CASE WHEN l.doc_id IS NOT NULL THEN 'B' END AS reliability FROM {_DOCS} x LEFT JOIN (SELECT DISTINCT ON (doc_id) doc_id, toxic FROM labels) l ON x.doc_id = l.doc_id",
        "bundle_records": f"SELECT doc_hash, locator AS source_locator, concat_ws(',', {flags}) AS flags, {TOKENS_SQL} AS tokens FROM {_DOCS} x",
        "record_order": f"SELECT row_number() OVER (ORDER BY doc_hash, string_split(locator, '/')) AS place, doc_hash, locator AS source_locator FROM {_DOCS} x",
        "bundle_checks": _values([("merkle_root", _ROOT), ("document_count", count), ("total_bytes", size), ("hash_alg", "'sha256'"), ("records_count", count), ("policy", "'docgauge-default/0.1.0'"), *((f"before: {c}", "'True'") for c in checks), ("amended", "'real'"), ("other key", "'False'"), ("after: files", "'False'"), ("after: changed, added, removed", "'1, 1, 1'")]),
        "investigation": _values([("findings", len(rules)), ("clause", "'integrity.near_empty'"), ("locator", first.format("locator")), ("text", first.format("left(t, 50)")), ("chars", first.format("length(t)")), ("similarity", "'1.0'"), ("changes", "'0'"), ("refused", "'3'"), ("logged", "'8'"), ("tools", "'diff_documents,get_finding,get_record,list_findings,propose,read_document'"), ("states", "'approved,rejected'"), ("assessment", "'artifact'")]),
        "derived_corpus": f"SELECT {_ROOT} AS parent_root, 'filter' AS relation, count(*) AS document_count, coalesce(sum(strlen(t)), 0)::BIGINT AS total_bytes FROM {_DOCS} x WHERE lang = 'en'",
        "stream_flag_counts": f"SELECT 1767225600 + (doc_id // 60) * 3600 AS start, count(*) AS docs, sum({TOKENS_SQL})::BIGINT AS tokens, {', '.join(f'sum(({FLAG_SQL[n]})::INT)::BIGINT AS {n}' for n in STREAM_FLAGS)} FROM {PLAIN_SQL} p GROUP BY 1",
    }


FILE_ORACLES = _oracles()
