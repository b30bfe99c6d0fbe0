"""The documents table as documents with envelopes, for measuring at scale.

The table has no envelopes and hardly any defects. Where a query needs them they are made from
doc_id by the same rules in Spark and in SQL, as each query says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ADAPTER, CUSTODY, DOCS


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def defect_text() -> Column:
    """Every 11th text gets a banner, every 7th a portion mark, every 13th a BEL, every 17th a tag, every 19th a placeholder."""
    i, t = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    t = F.when(i % 7 == 0, F.concat(F.lit("(S//NF) marked line\n"), t)).otherwise(t)
    t = F.when(i % 11 == 0, F.concat(F.when(i % 2 == 0, F.lit("SECRET//NOFORN\n")).otherwise(F.lit("CUI\n")), t)).otherwise(t)
    t = F.when(i % 13 == 0, F.concat(t, F.lit("\x07"))).otherwise(t)
    t = F.when(i % 17 == 0, F.concat(t, F.lit("<b>bold</b> &amp;"))).otherwise(t)
    return F.when(i % 19 == 0, F.concat(t, F.lit("\nsee [REDACTED] there"))).otherwise(t)


#: defect_text() in SQL.
DEFECT_SQL = """(SELECT doc_id, source, lang,
  CASE WHEN doc_id % 11 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'SECRET//NOFORN' || chr(10) ELSE 'CUI' || chr(10) END ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN '(S//NF) marked line' || chr(10) ELSE '' END
  || coalesce(text, '')
  || CASE WHEN doc_id % 13 = 0 THEN chr(7) ELSE '' END
  || CASE WHEN doc_id % 17 = 0 THEN '<b>bold</b> &amp;' ELSE '' END
  || CASE WHEN doc_id % 19 = 0 THEN chr(10) || 'see [REDACTED] there' ELSE '' END AS text
  FROM documents)"""


def read_documents(spark: SparkSession, sf_dir: str, defects: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """DOCS, doc_id, and more columns of the table: source_system is source, source_id doc_id div 40 with every fifth missing, collected_at a day
    of 2026 with every 9th missing, custody for even ids, reliability for every third, a parent for every 10th."""
    i = F.col("doc_id")
    rows = read_table(spark, sf_dir, "documents").withColumn("text", defect_text() if defects else F.coalesce(F.col("text"), F.lit("")))
    none = lambda kind: F.lit(None).cast(kind)
    day = F.concat(F.lit("2026-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    out = rows.select(
        "doc_id", *more, F.sha2(F.col("text").cast("binary"), 256).alias("doc_hash"), "text", F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("source").alias("source_system"), i.cast("string").alias("source_locator"),
        F.when(i % 5 != 0, F.floor(i / 40).cast("string")).alias("source_id"), F.when(i % 9 != 0, day).alias("collected_at"),
        none("string").alias("media_type"), F.lit("2026-01-01T00:00:00Z").alias("ingested_at"),
        F.when(i % 2 == 0, F.array(F.struct(F.lit("intake").alias("actor"), F.lit("2026-01-01T00:00:00Z").alias("at"), none("string").alias("action")))).cast(CUSTODY).alias("custody"),
        none("array<string>").alias("markings"), F.when(i % 10 == 0, F.sha2(i.cast("string").cast("binary"), 256)).alias("parent_hash"),
        F.when(i % 3 == 0, F.struct(F.get(F.array(*[F.lit(x) for x in "ABC"]), (i % 9 / 3).cast("int")).alias("source"), F.when(i % 2 == 0, "1").alias("information"))).alias("reliability"),
        F.struct(F.lit("table").alias("name"), F.lit("0.1.0").alias("version"), none("double").alias("extraction_confidence"), none("string").alias("path")).cast(ADAPTER).alias("adapter"),
    )
    return out.select("doc_id", *more, *[f.name for f in DOCS])
