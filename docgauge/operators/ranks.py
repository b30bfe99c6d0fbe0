"""Places of rows in a global order, without moving a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled

#: Rows of a table that may be broadcast (some MB); a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000


def beside(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns that a settled table has for their keys. The table is broadcast only if it is proven small.

    Otherwise both sides are dealt out by an expression, of which nobody knows how it lies, so adaptive execution can split a hot key.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    deal = lambda df: df.withColumn("__deal", F.xxhash64(*keys))
    return deal(rows).join(deal(table), ["__deal", *keys], how).drop("__deal")


def in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Settled rows with mid, a whole number that grows with keys (nulls first); bits from 33 on are the partition's number.

    Rows are dealt by range. Equal keys are told apart by where the rows were read, so that no key fills a task.
    """
    rows = settled(rows).withColumn("__at", F.monotonically_increasing_id())
    order: list[Column] = [F.col(c).asc_nulls_first() for c in (*keys, "__at")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__at")
    return settled(sorted_rows.withColumn("mid", F.monotonically_increasing_id()))


def ranked(rows: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """rows with pos, their place from 0 in their group (a column without nulls) by keys, and n, the group's size.

    A group has one run of rows in each partition it reaches, so the windows hold as many rows as there are partitions at most.
    """
    rows = in_order(rows, [group, *keys]).withColumn("__part", F.shiftright("mid", 33))
    runs = rows.groupBy(group, "__part").agg(F.min("mid").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = settled(runs.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("n")))
    return beside(rows, runs, [group, "__part"]).withColumn("pos", F.col("mid") + F.col("__shift")).drop("mid", "__part", "__shift")
