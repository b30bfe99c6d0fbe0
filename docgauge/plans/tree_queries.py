"""Registered queries over lineage, Merkle nodes, differences between corpora, numbered lines and streams, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.lineage import closure
from ..sources.lines import numbered
from ..sources.scratch import settled, shared_folder
from ..sources.tables import read_documents, read_table
from ..streaming.copies import copies, current
from . import merkle_levels as ml
from .queries import PLAIN_SQL

#: Who a document was derived from, as an expression over doc_id; among them cycles and parents that are not there.
PARENT = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 50 = 3 THEN doc_id + 1 WHEN doc_id % 50 = 4 THEN doc_id - 1 WHEN doc_id % 41 = 0 THEN -1 - doc_id WHEN doc_id % 3 = 0 THEN doc_id - 1 ELSE cast(floor(doc_id / 2) AS bigint) END"
CHANGED, GONE = "doc_id % 37 = 5", "doc_id % 11 = 3"


def lineage(spark, d):
    """Each document's topmost ancestor, its distance, and the characters of all it came from."""
    docs = read_table(spark, d, "documents")
    found = closure(docs.select(F.col("doc_id").alias("id"), F.expr(PARENT).alias("parent"), F.length(F.coalesce("text", F.lit(""))).alias("value")))
    return found.withColumn("total", F.col("total").cast("long"))


def lineage_trees(spark, d):
    """The documents of each tree and how deep it is; state tells what stands at its top."""
    state = F.max(F.when(F.col("id") == F.col("top"), F.col("state"))).alias("state")  # a tree has one document that is its own top
    return lineage(spark, d).where("top IS NOT NULL").groupBy("top").agg(state, F.count(F.lit(1)).alias("docs"), F.max("depth").alias("depth"))


def _tree(spark, d):
    docs = read_documents(spark, d).select("doc_id", "doc_hash")
    return docs, settled(ml.levels(docs))


def merkle_levels(spark, d):
    """Every node of the Merkle tree."""
    return _tree(spark, d)[1].select("level", "pos", "hash")


def merkle_multiproof(spark, d):
    """The nodes that prove all documents whose id is divisible by 100 at once, and the root that they give."""
    docs, tree = _tree(spark, d)
    leaves = docs.where("doc_id % 100 = 0").select(F.col("doc_hash").alias("hash")).distinct()
    proof = settled(ml.multiproof(tree, leaves))
    n = tree.where("level = 0").count()
    root = ml.fold(proof, tree.where("level = 0").join(leaves, "hash", "left_semi"), n)
    found = root.first()  # one row; none if the proof lacks a node
    return proof.select("level", "pos", "hash", F.lit(found["root"] if found else None).cast("string").alias("root"))


def _derived(spark, d):
    docs = read_documents(spark, d).select("doc_id", "doc_hash")
    told = F.when(F.expr(CHANGED), F.sha2(F.concat(F.lit("changed "), "doc_id").cast("binary"), 256)).otherwise(F.col("doc_hash"))
    return docs, docs.where(f"NOT ({GONE})").select("doc_id", told.alias("doc_hash"))


def reconciled(spark, d):
    """Leaves that a corpus or the one derived from it lacks, found by descending into ranges that differ."""
    return ml.reconcile(*_derived(spark, d))[0]


def corpus_relations(spark, d):
    """What each derived corpus is to its origin: a filter, a change, a union, the same."""
    docs, changed = _derived(spark, d)
    more = docs.select("doc_hash").unionByName(changed.select("doc_hash"))
    rows = []
    for name, other in (("filter", docs.where(f"NOT ({GONE})")), ("change", changed), ("union", more), ("same", docs)):
        sides, _ = ml.reconcile(docs, other)
        n = [x.select("doc_hash").distinct().count() for x in (docs, other)]
        only = {r["side"]: r["c"] for r in sides.groupBy("side").agg(F.count(F.lit(1)).alias("c")).collect()}
        rows.append((name, *n, only.get("a", 0), only.get("b", 0), ml.relation(*n, only.get("a", 0), only.get("b", 0))))
    return spark.createDataFrame(rows, "name string, n_a long, n_b long, only_a long, only_b long, relation string")


def numbered_lines(spark, d):
    """Documents written as JSON lines, three files in order, and read back by splits: a document's place from its line's number."""
    path = shared_folder(spark, "lines") / "files"
    docs = read_table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    docs.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select(F.to_json(F.struct("doc_id", "chars")).alias("value")).write.text(str(path))
    rows = settled(numbered(spark, str(path)).select("file", "no", F.from_json("value", "doc_id long, chars long").alias("v")))
    files = rows.groupBy("file").agg(F.min("v.doc_id").alias("first"), F.max("no").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each of three files
    return rows.join(files.select("file", before.alias("before")), "file").select("v.doc_id", (F.col("no") + F.col("before")).alias("place"), "v.chars")


def stream_copies(spark, d):
    """Documents as a stream of four batches: the first and the number of each hash's documents, from the table the stream has written."""
    root = shared_folder(spark, "stream")
    docs = read_documents(spark, d).select("doc_id", "doc_hash", (F.lit("2026-01-01").cast("timestamp") + F.make_interval(secs=F.col("doc_id"))).alias("at"))
    docs.repartitionByRange(4, "doc_id").write.parquet(str(root / "in"))
    rows = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(root / "in"))
    query = copies(rows, "at", late="36500 days").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(root / "state")).option("path", str(root / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    return current(spark.read.parquet(str(root / "out"))).select("doc_hash", "first_id", "copies")


QUERIES = {
    "lineage": lineage, "lineage_trees": lineage_trees, "merkle_levels": merkle_levels, "merkle_multiproof": merkle_multiproof, "reconciled": reconciled,
    "corpus_relations": corpus_relations, "numbered_lines": numbered_lines, "stream_copies": stream_copies,
}

_LINEAGE = f"""WITH RECURSIVE n AS (SELECT doc_id AS id, {PARENT} AS parent, length(coalesce(text, '')) AS value FROM documents),
m AS (SELECT n.*, p.id AS known FROM n LEFT JOIN n p ON p.id = n.parent),
-- From the tops down; what is never reached is on a cycle or leads into one.
w(id, top, depth, total, state) AS (
  SELECT id, id, 0::BIGINT, value::BIGINT, CASE WHEN parent IS NULL THEN 'root' ELSE 'orphan' END FROM m WHERE known IS NULL
  UNION ALL SELECT m.id, w.top, w.depth + 1, w.total + m.value, 'derived' FROM w JOIN m ON m.known = w.id),
c AS (SELECT * FROM m WHERE id NOT IN (SELECT id FROM w)),
r(id, up, step) AS (SELECT id, known, 1 FROM c UNION ALL SELECT r.id, c.known, step + 1 FROM r JOIN c ON c.id = r.up WHERE step < (SELECT count(*) FROM c) AND r.up <> r.id),
o AS (SELECT id, top, depth, total, state FROM w UNION ALL SELECT id, NULL, NULL, NULL, CASE WHEN bool_or(up = id) THEN 'cycle' ELSE 'into cycle' END FROM r GROUP BY id)"""

_NODES = f"""t(level, pos, hash, n) AS (
  SELECT 0, row_number() OVER (ORDER BY h) - 1, h, count(*) OVER () FROM (SELECT DISTINCT sha256(t) AS h FROM {PLAIN_SQL} p)
  UNION ALL SELECT a.level + 1, a.pos // 2, CASE WHEN b.hash IS NULL THEN a.hash ELSE sha256(unhex(a.hash) || unhex(b.hash)) END, (a.n + 1) // 2 FROM t a LEFT JOIN t b ON b.pos = a.pos + 1 WHERE a.n > 1 AND a.pos % 2 = 0)"""
_SETS = f"""a AS (SELECT DISTINCT sha256(t) AS hash FROM {PLAIN_SQL} p),
b AS (SELECT DISTINCT CASE WHEN {CHANGED} THEN sha256(concat('changed ', doc_id)) ELSE sha256(t) END AS hash FROM {PLAIN_SQL} p WHERE NOT ({GONE})),
f AS (SELECT DISTINCT sha256(t) AS hash FROM {PLAIN_SQL} p WHERE NOT ({GONE}))"""


def _relation_sql(name: str, other: str) -> str:
    return f"""SELECT '{name}' AS name, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM {other}) AS n_b, (SELECT count(*) FROM (SELECT hash FROM a EXCEPT SELECT hash FROM {other})) AS only_a,
 (SELECT count(*) FROM (SELECT hash FROM {other} EXCEPT SELECT hash FROM a)) AS only_b"""


ORACLES = {
    "lineage": f"{_LINEAGE} SELECT id, top, depth, total, state FROM o",
    "lineage_trees": f"{_LINEAGE} SELECT o.top, any_value(x.state) AS state, count(*) AS docs, max(o.depth) AS depth FROM o JOIN w x ON x.id = o.top GROUP BY 1",
    "merkle_levels": f"WITH RECURSIVE {_NODES} SELECT level, pos, hash FROM t",
    "merkle_multiproof": f"""WITH RECURSIVE {_NODES},
k AS (SELECT DISTINCT level::INT AS level, pos >> level AS pos FROM (SELECT t.pos, unnest(range(0, (SELECT max(level) + 1 FROM t))) AS level FROM t WHERE t.level = 0 AND hash IN (SELECT sha256(t) FROM {PLAIN_SQL} p WHERE doc_id % 100 = 0))),
p AS (SELECT t.* FROM t JOIN (SELECT DISTINCT level, xor(pos, 1) AS pos FROM k) s USING (level, pos) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.level = t.level AND k.pos = t.pos)),
-- The root again, from the leaves and the proof alone.
u(level, pos, hash, n) AS (
  SELECT 0, k.pos, t.hash, t.n FROM k JOIN t USING (level, pos) WHERE level = 0
  UNION ALL SELECT any_value(level) + 1, pos // 2, CASE WHEN count(*) = 2 THEN sha256(unhex(min_by(hash, pos)) || unhex(max_by(hash, pos))) ELSE min(hash) END, any_value((n + 1) // 2)
  FROM (SELECT level, pos, hash, n FROM u WHERE n > 1 UNION ALL SELECT p.level, p.pos, p.hash, p.n FROM p WHERE p.level = (SELECT max(level) FROM u WHERE n > 1)) GROUP BY pos // 2)
SELECT level, pos, hash, (SELECT hash FROM u WHERE n = 1) AS root FROM p""",
    "reconciled": f"WITH {_SETS} SELECT hash, 'a' AS side FROM (SELECT hash FROM a EXCEPT SELECT hash FROM b) UNION ALL SELECT hash, 'b' FROM (SELECT hash FROM b EXCEPT SELECT hash FROM a)",
    "corpus_relations": f"""WITH {_SETS}, u AS (SELECT hash FROM a UNION SELECT hash FROM b), r AS ({' UNION ALL '.join(_relation_sql(*x) for x in (('filter', 'f'), ('change', 'b'), ('union', 'u'), ('same', 'a')))})
SELECT *, CASE WHEN only_a = 0 AND only_b = 0 THEN 'equal' WHEN only_b = 0 THEN 'subset' WHEN only_a = 0 THEN 'superset' WHEN only_a = n_a AND only_b = n_b THEN 'disjoint' ELSE 'overlap' END AS relation FROM r""",
    "numbered_lines": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, length(coalesce(text, '')) AS chars FROM documents",
    "stream_copies": f"SELECT sha256(t) AS doc_hash, min(doc_id) AS first_id, count(*) AS copies FROM {PLAIN_SQL} p GROUP BY 1",
}
