"""Merkle trees over document hashes: sorted distinct leaves, an odd node moves up unchanged."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Leaves of an aligned block that one group reduces; a power of two.
BLOCK = 1 << 16


def parent(a: str, b: str) -> str:
    return hashlib.sha256(bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()


def _level(nodes: list[str]) -> list[str]:
    return [parent(*nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]


def root_of(leaves) -> str:
    nodes = sorted(set(leaves))
    if not nodes:
        return hashlib.sha256(b"").hexdigest()
    while len(nodes) > 1:
        nodes = _level(nodes)
    return nodes[0]


def proof(leaves, leaf: str) -> list[dict]:
    """The siblings from the leaf up, each with its side."""
    nodes = sorted(set(leaves))
    at, out = nodes.index(leaf), []
    while len(nodes) > 1:
        other = at ^ 1
        if other < len(nodes):
            out.append({"side": "left" if other < at else "right", "hash": nodes[other]})
        nodes, at = _level(nodes), at // 2
    return out


def proves(leaf: str, path: list[dict], root: str) -> bool:
    for step in path:
        leaf = parent(step["hash"], leaf) if step["side"] == "left" else parent(leaf, step["hash"])
    return leaf == root


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    nodes = rows.sort_values("i")["h"].tolist()
    size = BLOCK
    while size > 1:
        nodes, size = _level(nodes), size // 2
    return pd.DataFrame({"b": [rows["b"].iloc[0]], "h": nodes})


def merkle_root(hashes: DataFrame, col: str = "doc_hash") -> str:
    """The same root from a DataFrame: positions by a range sort, aligned blocks reduced apart, the few tops on the driver.

    Reducing a block of 2**k aligned leaves for k levels equals those levels of the whole tree, the last block included.
    """
    leaves = hashes.select(F.col(col).alias("h")).distinct()
    parts = max(1, leaves.sparkSession.sparkContext.defaultParallelism)
    ranged = leaves.repartitionByRange(parts, "h").withColumn("p", F.spark_partition_id()).persist()
    sizes = {r["p"]: r["n"] for r in ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return root_of([])
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    offset = F.element_at(F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n))]), F.col("p"))
    placed = ranged.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("h")) - 1 + offset)
    tops = placed.select("h", "i", F.floor(F.col("i") / BLOCK).alias("b")).groupBy("b").applyInPandas(_reduce, "b long, h string").orderBy("b").collect()
    ranged.unpersist()
    nodes = [r["h"] for r in tops]
    while len(nodes) > 1:
        nodes = _level(nodes)
    return nodes[0]
