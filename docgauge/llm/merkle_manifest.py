"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree of the groups' roots, and a proof for every leaf.

A parent is kept as its preimage, the hashes of its children written one after the other. A leaf's path is its ancestors'
preimages: without the leaf's own 64 characters they are the siblings of its proof, and with a changed hash
put into that place they are folded, level by level, to the root that the change would give.

Leaves are ranked by a range sort of their hashes alone; the texts are read once and never moved. Levels are not
joined one by one: BAND levels at a time are built in one row for each aligned block of 2**BAND nodes, so 10**10 leaves
take four rounds. Leaves then join the preimages of their block and of the blocks above it. A group that
holds most rows is many blocks. All is in DataFrame functions.

Defined cases: a null field is written ``-``, any other as its byte count, ``:`` and its value; null ids come first, rows of equal
id by their leaf; repeated rows are leaves of their own; a lone leaf is its group's root, a lone group's root the root; a run
of one node is hashed like any other; texts of any length are hashed whole; the null group comes first; 1 added to the largest
n_chars gives the next whole number; an empty table gives an empty result; further columns, whatever their names, do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import beside, ranked
from .common import pin, read, sql_crc32

#: Levels that are built in one row; such a row has 2**BAND nodes at most, some 250 KB of hashes.
BAND = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Characters of a hash.
SLOT = 64


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _digest(preimage: Column) -> Column:
    return F.sha2(preimage.cast("binary"), 256)


def _band(nodes: DataFrame, band: int) -> DataFrame:
    """(g, block, n, nodes, levels, top) for nodes (g, pos, n, hash, more): a row for each run of 2**band nodes.

    levels holds the preimages of the run's parents, grandparents and so on, top is the last one's hash.
    """
    runs = nodes.groupBy("g", "n", F.shiftright("pos", band).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "more"))).alias("nodes"))
    # A group of more than one run goes up all levels, another until one node is left.
    depth = F.filter(F.sequence(F.lit(1), F.lit(band)), lambda k: F.pow(F.lit(2), k - 1) < F.col("n"))

    def preimages(hashes: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: F.concat(F.get(hashes, i * 2), F.coalesce(F.get(hashes, i * 2 + 1), F.lit(""))))

    start = F.struct(F.transform("nodes", lambda x: x["hash"]).alias("now"), F.array().cast("array<array<string>>").alias("levels"))
    built = F.aggregate(
        depth, start, lambda a, _: F.struct(F.transform(preimages(a["now"]), _digest).alias("now"), F.concat(a["levels"], F.array(preimages(a["now"]))).alias("levels"))
    )
    return runs.select("g", "block", "n", "nodes", built.alias("b")).select("g", "block", "n", "nodes", F.col("b.levels").alias("levels"), F.get("b.now", F.lit(0)).alias("top"))


def _path(at: Column) -> Column:
    """The preimages above the node that stands at a place of its run, and which child's slot is its own."""
    return F.transform("levels", lambda level, k: F.struct(F.get(level, F.floor(at / F.pow(F.lit(2), k + 1)).cast("int")).alias("preimage"), (F.floor(at / F.pow(F.lit(2), k)) % 2).cast("int").alias("slot")))


def tree(nodes: DataFrame, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """Of nodes (g, pos, n, hash, more): (g, root), and (g, hash, more, path), path from the node up to its group's root."""
    bands, large = [], F.col("n") > (1 << band)
    while True:
        bands.append(pin(_band(nodes, band)))
        if not bands[-1].where(large).limit(1).count():
            break
        runs = F.shiftright(F.col("n") + ((1 << band) - 1), band)
        nodes = bands[-1].where(large).select("g", F.col("block").alias("pos"), runs.alias("n"), F.col("top").alias("hash"), F.lit(None).cast("string").alias("more"))
    roots = None
    for b in bands:
        found = b.where(~large).select("g", F.col("top").alias("root"))
        roots = found if roots is None else roots.unionByName(found)
    above = None  # (g, block, up): the path of each run's top
    for k, b in reversed(list(enumerate(bands))):
        none = F.array().cast("array<struct<preimage:string,slot:int>>")
        if above is None:
            b = b.withColumn("up", none)
        else:
            b = b.join(above, ["g", "block"], "left").withColumn("up", F.coalesce("up", none))
        own = F.transform("nodes", lambda x, i: F.struct(i.alias("i"), x["hash"].alias("hash"), x["more"].alias("more"), _path(i).alias("own")))
        rows = b.select("g", "block", "up", F.inline(own))
        path = F.concat("own", "up")
        if k:
            above = rows.select("g", (F.shiftleft("block", band) + F.col("i")).alias("block"), path.alias("up"))
        else:
            return roots, rows.select("g", "hash", "more", path.alias("path"))
    raise AssertionError("a tree has a band at least")


def siblings(path: Column) -> Column:
    """The other children's hashes at each level; runs of one node have none."""
    return F.transform(path, lambda p: F.concat(F.substring(p["preimage"], F.lit(1), p["slot"] * SLOT), F.substring(p["preimage"], p["slot"] * SLOT + SLOT + 1, F.lit(SLOT))))


def folded(path: Column, leaf: Column) -> Column:
    """The root that path gives for another leaf in the same place."""
    return F.aggregate(path, leaf, lambda h, p: _digest(F.overlay(p["preimage"], h, p["slot"] * SLOT + 1, F.lit(SLOT))))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", tampered: list[Column] | None = None, changed: Column | None = None, band: int = BAND) -> DataFrame:
    """doc_id, group, leaf, path, subroot, root and other for every row; other is the leaf of the values tampered where changed holds, else null."""
    group = F.col(group_col).cast("string")
    key = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group))  # "-" comes before "="
    other = F.lit(None).cast("string") if tampered is None else F.when(changed, leaf_hash(tampered))
    leaves = docs.select(key.alias("g"), F.col(id_col).alias("doc_id"), leaf_hash([F.col(c) for c in fields]).alias("hash"), other.alias("other"))
    leaves = ranked(leaves, "g", ["doc_id", "hash"]).select("g", "pos", "n", "hash", F.struct("doc_id", "other").alias("more"))
    roots, paths = tree(leaves, band)
    roots = pin(roots)
    tops = ranked(roots.select(F.lit("all").alias("all"), "g", "root"), "all", ["g"])
    top, top_paths = tree(tops.select(F.col("all").alias("g"), "pos", "n", F.col("root").alias("hash"), F.col("g").alias("more")), band)
    # top has one row, for the one tree of roots.
    groups = pin(top_paths.join(F.broadcast(top), "g").select(F.col("more").alias("g"), F.col("hash").alias("subroot"), F.col("path").alias("top_path"), "root"))
    out = beside(paths, groups, ["g"])
    group = F.when(F.col("g") != "-", F.expr("substring(g, 2)"))
    return out.select(F.col("more.doc_id").alias("doc_id"), group.alias("group"), F.col("hash").alias("leaf"), F.concat("path", "top_path").alias("path"), "subroot", "root", F.col("more.other").alias("other"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(docs, tampered=[more if c == "n_chars" else F.col(c) for c in FIELDS], changed=changed)
    new = folded(F.col("path"), F.coalesce("other", "leaf"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings(F.col("path")), "").cast("binary"), 256).alias("proof_sha256"), new.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    leaf = lambda more: "sha256(concat({}))".format(
        ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({v}::VARCHAR), ':', {v}) END" for c in FIELDS for v in [f"({c}::HUGEINT + 1)" if more and c == "n_chars" else c])
    )
    # Nodes (g, level, pos, h); t are the groups' trees, u the tree of their roots.
    step = lambda name: f"""SELECT a.g, a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(concat(a.h, coalesce(b.h, '')))
  FROM {name} a LEFT JOIN {name} b ON b.g = a.g AND b.pos = a.pos + 1 WHERE a.n > 1 AND a.pos % 2 = 0"""  # noqa: E731
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, {leaf(False)} AS leaf, CASE WHEN {sql_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {leaf(True)} ELSE {leaf(False)} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t(g, level, pos, n, h) AS (SELECT g, 0, pos, n, leaf FROM p UNION ALL {step("t")}),
r AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(g, level, pos, n, h) AS (SELECT '', 0, pos, n, subroot FROM r UNION ALL {step("u")}),
-- A walk from each leaf up both trees, with the siblings so far and the hash that the changed leaf gives.
w(rid, doc_id, leaf, g, top, level, pos, n, proof, h) AS (
  SELECT row_number() OVER (), doc_id, leaf, g, false, 0, pos, n, '', other FROM p
  UNION ALL
  SELECT w.rid, w.doc_id, w.leaf, w.g, w.top OR w.n = 1, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.n = 1 THEN r.pos ELSE w.pos // 2 END, CASE WHEN w.n = 1 THEN r.n ELSE (w.n + 1) // 2 END,
    CASE WHEN w.n = 1 THEN w.proof ELSE concat(w.proof, s.h, z.h) END,
    CASE WHEN w.n = 1 THEN w.h WHEN w.pos % 2 = 0 THEN sha256(concat(w.h, s.h, z.h)) ELSE sha256(concat(s.h, z.h, w.h)) END
  FROM w JOIN r ON r.g = w.g
  LEFT JOIN t s ON NOT w.top AND s.g = w.g AND s.level = w.level AND s.pos = xor(w.pos, 1)
  LEFT JOIN u z ON w.top AND z.level = w.level AND z.pos = xor(w.pos, 1)
  WHERE NOT (w.top AND w.n = 1))
SELECT w.doc_id, w.leaf, r.subroot, e.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = e.h AS verified
FROM w JOIN r ON r.g = w.g JOIN u e ON e.n = 1 WHERE w.top AND w.n = 1
"""


OP12_SQL = _sql()
