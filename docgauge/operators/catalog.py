"""The metric catalog: what is measured, and what is named but has no definition to compute by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import METRICS

CATALOG_VERSION = "docgauge-0.1"
FAMILIES = {"dup": "duplication", "vol": "volume", "cnt": "volume", "int": "integrity", "mark": "markings", "prov": "provenance"}

#: Names without an implementation, by family: they depend on detectors or libraries that aren't here.
NAMED_ONLY = {
    "descriptive": 13, "language": 12, "lexical": 3, "readability": 13, "compliance": 3, "model_fit": 3, "entities": 19,
}


def metric(metric_id: str) -> dict:
    """An implemented metric's entry; KeyError for any other."""
    return {"metric_id": metric_id, "family": FAMILIES[metric_id.split(".")[0]], "unit": METRICS[metric_id]}


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(metric(m).values()) for m in METRICS], "metric_id string, family string, unit string")
