"""Scoring documents as they arrive. An addition: per-document columns need no state, so they work on streams.

Exact and near duplicates and quantiles need all rows and stay with the batch engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.families import Integrity, Volume

FLAGS = ("empty", "near_empty", "truncated", "mojibake", "control_chars", "markup_residue")


def score(docs: DataFrame) -> DataFrame:
    """A stream (or table) with text and size_bytes, with the volume and integrity columns."""
    return docs.withColumns(Volume().columns() | Integrity().columns())


def flag_counts(docs: DataFrame, time_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Documents, tokens and flags per window of event time; rows later than the watermark are left out."""
    rows = docs.withWatermark(time_col, late).withColumns({f: c for f, c in Integrity().columns().items() if f in FLAGS})
    counts = [F.count_if(F.col(f)).alias(f) for f in FLAGS]
    return rows.groupBy(F.window(time_col, window).alias("w")).agg(F.count(F.lit(1)).alias("docs"), F.sum(tx.token_estimate(F.col("text"))).alias("tokens"), *counts).select("w.start", "w.end", "docs", "tokens", *FLAGS)
