"""Lines of text files with their numbers, read in splits.

A file is read by as many tasks as it has splits. A line's number is its place in its split plus the lines of the file's earlier
splits, so a split is counted once and nothing but a row for each split is moved.

Defined cases: numbers begin at 1 in each file, or in the first of a folder's files by path if they go through; empty lines count; lines end at CR, LF or CR LF, as Spark's text source splits them;
a file without lines has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import beside
from ..sources.scratch import settled


def numbered(spark: SparkSession, path: str, through: bool = False) -> DataFrame:
    """(file, no, value) of every line of a text file or of all below a folder. through: files go on where the one before ended."""
    own = F.col("_metadata")
    rows = spark.read.text(str(path)).select("value", own["file_path"].alias("file"), own["file_block_start"].alias("split")).withColumn("at", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("file", "split") if through else Window.partitionBy("file").orderBy("split")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    splits = settled(splits.select("file", "split", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")))
    return beside(rows, splits, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("no"), "value")
