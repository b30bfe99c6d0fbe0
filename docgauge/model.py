"""Schemas of documents and results, and what is fixed about them."""

from __future__ import annotations

from pyspark.sql import types as T

HASH_ALG = "sha256"
CUSTODY = T.ArrayType(T.StructType([T.StructField("actor", T.StringType()), T.StructField("at", T.StringType()), T.StructField("action", T.StringType())]))
RELIABILITY = T.StructType([T.StructField("source", T.StringType()), T.StructField("information", T.StringType())])
ADAPTER = T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("extraction_confidence", T.DoubleType()), T.StructField("path", T.StringType())])

#: The envelope's optional fields that a provenance sidecar may set, with their types.
SIDECAR = T.StructType(
    [
        T.StructField("source_system", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("collected_at", T.StringType()),
        T.StructField("custody", CUSTODY),
        T.StructField("markings", T.ArrayType(T.StringType())),
        T.StructField("parent_hash", T.StringType()),
        T.StructField("reliability", RELIABILITY),
        T.StructField("media_type", T.StringType()),
    ]
)

#: A document: its envelope, flat, and its text. Null means absent.
DOCS = T.StructType(
    [
        T.StructField("doc_hash", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("source_locator", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("collected_at", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("ingested_at", T.StringType()),
        T.StructField("custody", CUSTODY),
        T.StructField("markings", T.ArrayType(T.StringType())),
        T.StructField("parent_hash", T.StringType()),
        T.StructField("reliability", RELIABILITY),
        T.StructField("adapter", ADAPTER),
    ]
)

#: Metric: unit. In the order in which they are reported.
METRICS = {
    "dup.exact_count": "docs", "dup.exact_rate": "fraction", "dup.near_count": "docs", "dup.near_rate": "fraction",
    "vol.total_docs": "docs", "vol.total_tokens": "tokens", "cnt.token_count": "tokens",
    "int.empty_count": "docs", "int.empty_rate": "fraction", "int.near_empty_rate": "fraction", "int.truncation_rate": "fraction",
    "int.mojibake_rate": "fraction", "int.control_char_rate": "fraction", "int.markup_residue_rate": "fraction",
    "int.large_count": "docs", "int.large_rate": "fraction",
    "int.boilerplate_share": "fraction", "int.intra_doc_repetition": "fraction", "int.ngram_repetition": "fraction",
    "mark.coverage": "fraction", "mark.conflict_rate": "fraction", "mark.ceiling_breach": "docs", "mark.redaction_residue_rate": "fraction",
    "prov.source_histogram": None, "prov.date_range": None, "prov.undated_rate": "fraction", "prov.custody_complete_rate": "fraction",
    "prov.reliability_histogram": None, "prov.derived_share": "fraction", "prov.duplicate_id_count": "docs", "prov.duplicate_id_rate": "fraction",
}


def result(metric_id: str, value, version: str, distribution: dict | None = None, scope: str | None = None) -> dict:
    """A corpus result; value stays even when null, other absent attributes don't."""
    out = {"metric_id": metric_id, "method_version": version, "value": value}
    for key, v in (("unit", METRICS.get(metric_id)), ("distribution", distribution), ("scope", scope if scope != "all" else None)):
        if v is not None:
            out[key] = v
    return out


def rate(count: int, of: int) -> float:
    """count / of to six places, halves to even on the binary value; 0.0 of nothing."""
    return round(count / of, 6) if of else 0.0
