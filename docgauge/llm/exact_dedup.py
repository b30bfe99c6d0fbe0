"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

The first scan groups rows by length. The second computes the prefix hash of rows whose length is
shared, the third the full hash of rows that share length and prefix. Which lengths and prefixes are shared
reaches the next scan as a bitmap of bounded size. Bits may be set by chance; that costs a hash and never
changes the result, because the full hash decides. Groups of a great many copies are joined
without moving their rows (common.join_counted).

Defined cases: a null text counts as empty, so all null and empty texts are one
group; a null id sorts after every other; of repeated rows (same id and text) exactly one
is kept; very long texts are hashed whole; an empty table gives an empty result; further input columns,
whatever their names, do no harm, and a filter returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, drop_rows, join_counted, marked, packed, pin, read, sketch, text_of

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Each run of white space as one space; a lone space needs no replacement and is skipped."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " ")


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc (all columns), t (the normalised text) and hit: whether length and then prefix may be shared with another row.

    The first scan reads lengths alone. The second hashes the prefixes of rows whose length is shared, and none else.
    """
    rows = packed(docs, normalised(text_of(text_col)).alias("t")).withColumn("len", F.octet_length("t"))
    n = F.count(F.lit(1)).alias("n")
    lengths = pin(rows.groupBy("len").agg(n).where("n > 1").select("len"))
    rows = marked(rows, F.xxhash64("len"), sketch(lengths, F.xxhash64("len")), "same_len")
    rows = rows.withColumn("prefix", F.when(F.col("same_len"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS))))
    pair = F.xxhash64("len", "prefix")
    prefixes = pin(rows.where("same_len").groupBy("len", "prefix").agg(n).where("n > 1").select("len", "prefix"))
    rows = marked(rows, pair, sketch(prefixes, pair), "again")
    return rows.select("doc", "t", (F.col("same_len") & F.col("again")).alias("hit"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _decided(rows: DataFrame, id_col: str, digest_all: bool) -> DataFrame:
    """exact_dedup()'s columns for candidates()."""
    sha = F.when(F.lit(digest_all) | F.col("hit"), _digest(F.col("t")))
    full = pin(rows.select(F.col(f"doc.`{id_col}`").alias("doc_id"), "hit", sha.alias("sha")).withColumn("rid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("rid")))
    groups = full.where("hit").groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = pin(groups.select(F.col("sha").alias("g"), F.col("first.id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "n"))
    met = join_counted(full.where("hit"), groups, "sha", "g", "n", "left").select("doc_id", "sha", "rid", "keep_id", "keep_rid", "n")
    none = F.lit(None).cast("long")
    alone = full.where("NOT hit").select("doc_id", "sha", "rid", F.col("doc_id").alias("keep_id"), none.alias("keep_rid"), none.alias("n"))
    single = F.col("n").isNull()
    return met.unionByName(alone).select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    text_sha256 is null for rows that refinement proved unique before their content was
    hashed, unless digest_all asks for it everywhere.
    """
    return _decided(candidates(docs, text_col), id_col, digest_all)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that exact_dedup keeps, with their own columns, for use as a filter stage.

    Rows that refinement proves unique are neither hashed nor moved.
    """
    rows = candidates(docs, text_col)
    every = _decided(rows, id_col, False).where("text_sha256 IS NOT NULL")
    keys = every.groupBy(F.col("doc_id").alias("k0"), F.col("text_sha256").alias("k1")).agg(F.max("kept").alias("once"), F.count(F.lit(1)).alias("c"))
    gone = keys.where("NOT once OR c > 1")  # once: the row that stays was given more than once
    alone = rows.where("NOT hit").select("doc.*")
    return alone.unionByName(drop_rows(rows.where("hit").select("doc.*"), [F.col(id_col), _digest(normalised(text_of(text_col)))], gone))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
