"""What documents were derived from: for each its topmost known ancestor, how far that is, and sums over all it came from.

Parents are followed by pointer jumping: each round doubles the distance a document looks up, so a chain of n takes about log n rounds
of one join each. If a round finishes none, no finite chain is left: one would have a document at every distance, and the nearest
of those would have finished. What remains is on a cycle or leads into one; after enough further rounds every pointer is on a
cycle, and all of a cycle's documents are pointed at, which tells them apart.

A parent of many children is hot on one side of the join alone, and has one row on the other; the join is dealt so that Spark can split it.

Defined cases: a null parent, or one that is the document itself, makes a root of the former and a cycle of the latter; a parent that is not
there makes the document an orphan, which is its own top; of repeated ids the row with the largest parent counts; values that are
null count as 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled

STATES = ("root", "orphan", "derived", "cycle", "into cycle")


def closure(nodes: DataFrame) -> DataFrame:
    """(id, top, depth, total, state) for nodes (id, parent, value).

    total is the value summed over the document and all its ancestors. A document on a cycle, or leading into one, has no top, depth or total.
    """
    own = settled(nodes.groupBy("id").agg(F.max(F.struct("parent", F.coalesce("value", F.lit(0)).alias("value"))).alias("m")).select("id", "m.parent", F.col("m.value").cast("double").alias("value")))
    open_ = F.col("there_").isNotNull()
    linked = _looked_up(own, own.select(F.col("id").alias("id_"), F.lit(True).alias("there_")), "parent")
    # ptr: the document itself once its top is known; far: how many steps up ptr is; total: the values on the way, an open ptr's own not among them.
    state = settled(
        linked.select(
            "id", F.when(open_, F.col("parent")).otherwise(F.col("id")).alias("ptr"), F.when(open_, 1).otherwise(0).cast("long").alias("far"), F.col("value").alias("total"),
            F.when(~open_, F.col("id")).alias("top"), F.when(F.col("parent").isNull(), "root").when(~open_, "orphan").alias("kind"),
        )
    )
    left, last = state.where("kind IS NULL").count(), None
    while left and left != last:
        state, last = settled(_round(state)), left
        left = state.where("kind IS NULL").count()
    out = state.where("kind IS NOT NULL").select("id", "top", F.col("far").alias("depth"), "total", F.col("kind").alias("state"))
    return out.unionByName(_cycles(state.where("kind IS NULL").select("id", "ptr"))) if left else out


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table (id_, ...) for the id in key, null where there is none; dealt so that a hot key can be split."""
    deal = lambda df, c: df.withColumn("__" + c, F.xxhash64(c))
    met = deal(rows, key).join(deal(table, "id_"), (F.col("__" + key) == F.col("__id_")) & (F.col(key) == F.col("id_")), "left")
    return met.drop("__" + key, "__id_", "id_")


def _round(state: DataFrame) -> DataFrame:
    """Open rows that point at a document whose top is known take it over; the others look twice as far. One join, whatever is left."""
    met = _looked_up(state, state.select([F.col(c).alias(f"{c}_") for c in state.columns]), "ptr")
    stays, told = F.col("kind").isNotNull(), F.col("kind_").isNotNull()
    return met.select(
        "id", F.when(stays | told, F.col("id")).otherwise(F.col("ptr_")).alias("ptr"), F.when(stays, F.col("far")).otherwise(F.col("far") + F.col("far_")).alias("far"),
        F.when(stays, F.col("total")).otherwise(F.col("total") + F.col("total_")).alias("total"), F.when(stays, F.col("top")).otherwise(F.col("top_")).alias("top"),
        F.when(stays, F.col("kind")).when(told, "derived").alias("kind"),
    )


def _cycles(now: DataFrame) -> DataFrame:
    """What is on a cycle or leads into one; all rows (id, ptr) look equally far.

    What is pointed at from twice as far is part of what is pointed at now. As soon as both are equally many, steps permute them, so they are
    the cycles: that takes as many rounds as the longest way into a cycle has binary digits.
    """
    before, here = None, now.select("ptr").distinct().count()
    while here != before:
        now = settled(_looked_up(now, now.select(F.col("id").alias("id_"), F.col("ptr").alias("next")), "ptr").select("id", F.col("next").alias("ptr")))
        before, here = here, now.select("ptr").distinct().count()
    told = _looked_up(now, now.select(F.col("ptr").alias("id_")).distinct().withColumn("on", F.lit(True)), "id")
    return told.select("id", F.lit(None).cast(now.schema["id"].dataType).alias("top"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("double").alias("total"), F.when(F.col("on"), "cycle").otherwise("into cycle").alias("state"))


def of_documents(docs: DataFrame, value: str = "size_bytes") -> DataFrame:
    """closure() over doc_hash and parent_hash."""
    return closure(docs.select(F.col("doc_hash").alias("id"), F.col("parent_hash").alias("parent"), F.col(value).alias("value")))
