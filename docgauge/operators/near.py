"""Near duplicates by MinHash signatures and banding, confirmed on the signatures.

The family of hash functions is our own and fixed: h is the first 28 bits of a shingle's
SHA-1, slot i is the minimum of (a_i h + b_i) mod 2**31 - 1. SQL can state it, so can an oracle.
Index and confirmation follow the usual choice for a threshold of 0.8: 25 bands of 5 rows.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import settled
from .ranks import beside

SLOTS, BANDS, ROWS, SHINGLE, THRESHOLD = 128, 25, 5, 5, 0.8
PRIME = (1 << 31) - 1


def coefficients(slots: int = SLOTS, seed: int = 1) -> list[tuple[int, int]]:
    """The fixed (a, b) of each slot, drawn from a seeded generator."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(slots)]


_A, _B = (np.array(x, np.uint64) for x in zip(*coefficients()))


def _signature(words: list[str]) -> list[int] | None:
    if len(words) < SHINGLE:
        return None
    found = {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
    digests = b"".join([hashlib.sha1(s.encode()).digest()[:4] for s in found])
    h = np.frombuffer(digests, ">u4").astype(np.uint64) >> np.uint64(4)
    best = np.full(SLOTS, PRIME, np.uint64)
    for k in range(0, len(h), 256):  # a bounded product at a time, however long the text, and one that fits a CPU's cache
        x = h[k : k + 256, None] * _A + _B
        # Modulo 2**31 - 1 without a division: x is below 2**60, so what is added up here is below twice the prime.
        x = (x >> np.uint64(31)) + (x & np.uint64(PRIME))
        best = np.minimum(best, np.minimum(x, x - np.uint64(PRIME)).min(axis=0))
    return best.astype(np.int64).tolist()


def _signatures(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _signature(t.strip(" ").split(" ")) if isinstance(t, str) else None)


def signatures(texts: DataFrame) -> DataFrame:
    """doc_hash and sig of each distinct text with at least SHINGLE words."""
    one = texts.groupBy("doc_hash").agg(F.first("text").alias("text"))
    # The optimizer would else compute a signature for the filter and again for the row.
    once = F.pandas_udf(_signatures, "array<int>").asNondeterministic()
    return one.select("doc_hash", once(tx.word_text(F.lower("text"))).alias("sig")).where("sig IS NOT NULL")


def rare_pairs(sigs: DataFrame, left: DataFrame, need: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(h, h2): pairs of a signature in left and one in sigs (h, sig) that may have need equal slots; none that have is missing.

    With columns by, which sigs and left have too, signatures meet only where these are equal.

    Each signature's slots are ordered by how many signatures have their value, the rarest first. Two signatures with need equal
    slots share one of the first SLOTS - need + 1 in this order (prefix filter). So signatures made from one template, whose common
    values are frequent, meet only in values of their own.
    """
    cells = sigs.select(*by, "h", F.posexplode("sig").alias("slot", "v"))
    often = settled(cells.groupBy(*by, "slot", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    ranked_cells = F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "slot", "v")))
    first = beside(cells, often, [*by, "slot", "v"], "left").groupBy(*by, "h").agg(F.slice(ranked_cells, 1, SLOTS - need + 1).alias("first"))
    # A value that no other signature has joins nothing.
    posts = settled(first.select(*by, "h", F.explode("first").alias("x")).select(*by, "h", "x.*").where("c > 1").drop("c"))
    own = posts.join(left.select(*by, "h"), [*by, "h"], "left_semi")
    return beside(own, posts.withColumnRenamed("h", "h2"), [*by, "slot", "v"]).where("h <> h2").select(*by, "h", "h2").distinct()


def near_hashes(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The hashes with at least one other hash in a shared band whose estimated similarity reaches the threshold."""
    return with_neighbours(settled(signatures(texts)), threshold)


def with_neighbours(each: DataFrame, threshold: float = THRESHOLD, by: tuple[str, ...] = ()) -> DataFrame:
    """The hashes of each (settled: by, doc_hash, sig; no row twice) with a neighbour, among those whose columns by are equal.

    That some neighbour exists is all the metric asks. Texts of equal signatures are neighbours of each other; one of
    them stands for all. Bands are dealt out as (band, key, hash) alone; signatures, half a kilobyte each and more than
    most texts, are fetched only for distinct pairs. In each bucket everyone is compared with the bucket's first, so a bucket of n near
    copies costs about n tests; those still without a neighbour are compared with what shares their rare values (rare_pairs), not
    with their whole buckets.
    """
    need = int(-(-threshold * SLOTS // 1))
    sigs = settled(each.groupBy(*by, "sig").agg(F.min("doc_hash").alias("h"), F.count(F.lit(1)).alias("n")))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.slice("sig", b * ROWS + 1, ROWS)).alias("key")) for b in range(BANDS)])
    rows = sigs.select(*by, "h", F.explode(bands).alias("b")).select(*by, "h", "b.band", "b.key")
    alike = F.aggregate(F.zip_with("sig", "sig2", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    shared = F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.slice("sig", b * ROWS + 1, F.lit(ROWS)) == F.slice("sig2", b * ROWS + 1, F.lit(ROWS)))
    own, other = sigs.select(*by, "h", "sig"), sigs.select(*by, F.col("h").alias("h2"), F.col("sig").alias("sig2"))

    def ends(pairs: DataFrame) -> DataFrame:
        """Both ends of the pairs (h, h2) that are close."""
        close = pairs.distinct().join(own, [*by, "h"]).join(other, [*by, "h2"]).where((alike >= need) & shared)
        return close.select(*by, F.explode(F.array("h", "h2")).alias("h")).distinct()

    hub = rows.groupBy(*by, "band", "key").agg(F.min("h").alias("h2"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    met = settled(rows.join(hub, [*by, "band", "key"]).select(*by, "h", "h2").distinct())
    first = settled(ends(met.where("h <> h2")))
    # Only signatures whose buckets have company are looked at again.
    company = settled(own.join(met.select(*by, "h").distinct(), [*by, "h"], "left_semi"))
    left = settled(company.join(first, [*by, "h"], "left_anti").select(*by, "h"))
    found = first.union(sigs.where("n > 1").select(*by, "h"))
    if left.limit(1).count():
        found = found.union(ends(rare_pairs(company, left, need, by)))
    near = sigs.join(found.distinct(), [*by, "h"], "left_semi").select(*by, "sig")
    return settled(each.join(near, [*by, "sig"], "left_semi").select(*by, "doc_hash"))


class Neighbours:
    """Near hashes of a corpus (doc_hash), and of its parts. Texts are looked at once.

    Who has no neighbour in the corpus has none in a part, so parts look only at the signatures of the others.
    """

    def __init__(self, texts: DataFrame):
        each = settled(signatures(texts))
        self.corpus = with_neighbours(each)
        self.sigs = each.join(self.corpus, "doc_hash", "left_semi")

    def inside(self, members: DataFrame) -> DataFrame:
        """(scope, doc_hash) of members (the same columns, no row twice) with a neighbour in their own scope."""
        return with_neighbours(settled(members.join(self.sigs, "doc_hash")), by=("scope",))
