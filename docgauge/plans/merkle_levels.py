"""The Merkle tree as a table of its nodes, proofs for many leaves at once, and the comparison of two sets of leaves.

The tree is that of plans/merkle.py: sorted distinct leaves, an odd node moves up unchanged. Its nodes are rows (level, pos, hash), made
BAND levels at a time from aligned blocks, so a tree of 10**10 leaves takes four rounds and no row or task holds more than a block.

A proof of many leaves is the set of nodes that are needed and can't be computed from the leaves themselves: what neighbours share is told once.

Two sets of leaves are compared by digests of ranges of hashes, by their first hexadecimal digits: only ranges whose
digests differ are looked at again, by one more digit, and only in the last of them are leaves compared. A range's digest is its number
of leaves and four sums of their bits; digests add up, so those of short prefixes come from those of long ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import beside, ranked
from ..sources.scratch import settled

BAND = 10
#: Digits of the longest prefix, and leaves that a range of it should hold.
DIGITS, RANGE = 8, 64


def _parents(hashes: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int"))
    two = lambda i: F.sha2(F.concat(F.unhex(F.get(hashes, i * 2)), F.unhex(F.get(hashes, i * 2 + 1))), 256)
    return F.transform(pairs, lambda i: F.when(i * 2 + 1 < F.size(hashes), two(i)).otherwise(F.get(hashes, i * 2)))


def levels(hashes: DataFrame, col: str = "doc_hash", band: int = BAND) -> DataFrame:
    """(level, pos, hash, n): every node of the tree; n is the number of leaves. The root is the one node of the last level."""
    leaves = ranked(hashes.select(F.lit("").alias("g"), F.col(col).alias("hash")).distinct(), "g", ["hash"])
    nodes, at, out = settled(leaves.select("pos", "hash", "n")), 0, []
    while True:
        runs = nodes.groupBy("n", F.shiftright("pos", band).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("x"))
        width = F.shiftright(F.col("n") + ((1 << at) - 1), at)  # how many nodes this level has
        depth = F.filter(F.sequence(F.lit(1), F.lit(band)), lambda k: F.pow(F.lit(2), k - 1) < width)
        start = F.struct(F.transform("x", lambda x: x["hash"]).alias("now"), F.array(F.transform("x", lambda x: x["hash"])).alias("all"))
        built = F.aggregate(depth, start, lambda a, _: F.struct(_parents(a["now"]).alias("now"), F.concat(a["all"], F.array(_parents(a["now"]))).alias("all")), lambda a: a["all"])
        rows = settled(runs.select("n", "block", built.alias("all")))
        flat = rows.select("n", "block", F.posexplode("all").alias("up", "hashes")).select("n", "block", "up", F.posexplode("hashes").alias("i", "hash"))
        place = F.shiftleft("block", band)
        flat = flat.select((F.lit(at) + F.col("up")).alias("level"), (F.floor(place / F.pow(F.lit(2), F.col("up"))).cast("long") + F.col("i")).alias("pos"), "hash", "n")
        more = settled(rows.where(F.size("all") == band + 1).select(F.col("block").alias("pos"), F.get(F.get("all", F.lit(band)), F.lit(0)).alias("hash"), "n"))
        if more.limit(2).count() < 2:
            out.append(flat)
            return reduce(DataFrame.unionByName, out)
        out.append(flat.where(F.col("level") < at + band))
        nodes, at = more, at + band


def multiproof(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(level, pos, hash): the nodes that, with the leaves (hash), give the root. tree is levels(), settled."""
    depth = tree.agg(F.max("level").alias("d")).first()["d"] or 0
    mine = tree.where("level = 0").join(leaves.select("hash").distinct(), "hash", "left_semi").select("pos")
    known = mine.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "pos").select("level", F.floor(F.col("pos") / F.pow(F.lit(2), F.col("level"))).cast("long").alias("pos")).distinct()
    known = settled(known)
    needed = known.select("level", F.col("pos").bitwiseXOR(F.lit(1).cast("long")).alias("pos")).join(known, ["level", "pos"], "left_anti")
    return tree.select("level", "pos", "hash").join(settled(needed), ["level", "pos"])


def fold(proof: DataFrame, leaves: DataFrame, n: int) -> DataFrame:
    """(root): what leaves (pos, hash) and a proof give for a tree of n leaves; no row if a node is missing."""
    nodes, level = settled(leaves.select("pos", "hash")), 0
    proof = settled(proof)
    while n > 1:
        here = nodes.select("pos", "hash").unionByName(proof.where(F.col("level") == level).select("pos", "hash"))
        pair = here.groupBy(F.shiftright("pos", 1).alias("pos")).agg(F.array_sort(F.collect_set(F.struct("pos", "hash"))).alias("x"))
        two = F.sha2(F.concat(F.unhex(F.get("x", F.lit(0))["hash"]), F.unhex(F.get("x", F.lit(1))["hash"])), 256)
        whole = (F.size("x") == 2) & (F.get("x", F.lit(0))["pos"] != F.get("x", F.lit(1))["pos"])
        alone = (F.size("x") == 1) & (F.get("x", F.lit(0))["pos"] == n - 1) & F.lit(n % 2 == 1)
        nodes = settled(pair.select("pos", F.when(whole, two).when(alone, F.get("x", F.lit(0))["hash"]).alias("hash")))
        n, level = (n + 1) // 2, level + 1
    return nodes.where("hash IS NOT NULL AND pos = 0").select(F.col("hash").alias("root"))


# --- two sets of leaves ----------------------------------------------------------


def digests(leaves: DataFrame, col: str = "doc_hash", digits: int = DIGITS) -> DataFrame:
    """(prefix, n, d0..d3) of distinct leaves: a table to keep beside a corpus, far smaller than its leaves."""
    lane = lambda k: F.conv(F.substring("hash", 1 + 8 * k, 8), 16, 10).cast("decimal(10,0)")
    rows = leaves.select(F.col(col).alias("hash")).distinct()
    return rows.groupBy(F.substring("hash", 1, digits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(lane(2 * k) * lane(2 * k + 1)).alias(f"d{k}") for k in range(4)])


def shorter(table: DataFrame, digits: int) -> DataFrame:
    return table.groupBy(F.substring("prefix", 1, digits).alias("prefix")).agg(*[F.sum(c).alias(c) for c in ("n", "d0", "d1", "d2", "d3")])


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """The prefixes whose digests are not the same."""
    both = a.join(b.toDF(*[f"{c}_b" for c in b.columns]), F.col("prefix") == F.col("prefix_b"), "full")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in ("n", "d0", "d1", "d2", "d3")])
    return both.where(~same).select(F.coalesce("prefix", "prefix_b").alias("prefix"))


def depth_for(n: int) -> int:
    """Digits of the last prefixes for n leaves."""
    digits = 1
    while digits < DIGITS and 16**digits * RANGE < n:
        digits += 1
    return digits


def reconcile(a: DataFrame, b: DataFrame, col: str = "doc_hash", kept: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(hash, side): the leaves that only a or only b has; and how many ranges of each length of prefix were compared, how many leaves read.

    kept are the digests() of both, if they were kept; then leaves outside of differing ranges are not even read for digests.
    """
    full = [settled(x) for x in kept or (digests(a, col), digests(b, col))]
    n = max(x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] for x in full)
    last, told, open_ = depth_for(n), {}, None
    for k in range(1, last + 1):
        mine = [x if open_ is None else beside(x.withColumn("short", F.substring("prefix", 1, k - 1)), open_.withColumnRenamed("prefix", "short"), ["short"]).drop("short") for x in full]
        short = [settled(shorter(x, k)) for x in mine]
        told[f"ranges_{k}"] = short[0].select("prefix").union(short[1].select("prefix")).distinct().count()
        open_ = settled(differing(*short))
        if not open_.limit(1).count():
            break
    sides = []
    for x in (a, b):
        rows = x.select(F.col(col).alias("hash")).distinct().withColumn("prefix", F.substring("hash", 1, k))
        sides.append(settled(beside(rows, open_, ["prefix"]).select("hash")))
    told["leaves"] = sum(s.count() for s in sides)
    only = lambda x, y, name: x.join(y, "hash", "left_anti").select("hash", F.lit(name).alias("side"))
    return only(sides[0], sides[1], "a").unionByName(only(sides[1], sides[0], "b")), told


def relation(n_a: int, n_b: int, only_a: int, only_b: int) -> str:
    """What b is to a."""
    if not only_a and not only_b:
        return "equal"
    if not only_b:
        return "subset"
    if not only_a:
        return "superset"
    return "disjoint" if only_a == n_a and only_b == n_b else "overlap"
