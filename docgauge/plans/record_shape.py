"""The shape of a record, as conditions over its columns: all are counted in one pass before a bundle is signed.

A condition holds for a record, or the record breaks the field it is named after. Conditions about parts that a record may lack hold where
they are absent. Nothing of a record reaches the driver but a count for each condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markings as mk
from ..model import HASH_ALG
from ..operators.families import Family
from ..sources.directory import HEX64


class RecordError(ValueError):
    """Records aren't of their shape; the message says which fields how often."""


def _fine(c: Column) -> Column:
    return F.coalesce(c, F.lit(True))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


#: Fields that every record's envelope is asked for.
ENVELOPE = ("doc_hash", "hash_alg", "size_bytes", "source_system", "source_locator", "ingested_at", "adapter", "parent_hash", "reliability", "custody")


def field_names(families: list[Family], columns: list[str]) -> list[str]:
    """The names of conditions()."""
    out = ["doc_hash", *[f"envelope/{x}" for x in ENVELOPE], *(["flags"] if "flags" in columns else []), *[f"metrics/{m}" for m in sorted(m for f in families for m in f.metrics)]]
    return out + (["markings_parsed/level", "markings_parsed/marked"] if "markings_parsed" in columns else [])


def conditions(families: list[Family], columns: list[str]) -> dict[str, Column]:
    """Each field's condition, for records with these columns."""
    e = lambda f: F.col(f"envelope.{f}")
    out = {
        "doc_hash": _sure(F.col("doc_hash").rlike(HEX64)),
        "envelope/doc_hash": _sure(e("doc_hash") == F.col("doc_hash")),
        "envelope/hash_alg": _sure(e("hash_alg") == HASH_ALG),
        "envelope/size_bytes": _sure(e("size_bytes") >= 0),
        "envelope/source_system": e("source_system").isNotNull(),
        "envelope/source_locator": e("source_locator").isNotNull(),
        "envelope/ingested_at": e("ingested_at").isNotNull(),
        "envelope/adapter": e("adapter.name").isNotNull() & e("adapter.version").isNotNull(),
        "envelope/parent_hash": _fine(e("parent_hash").rlike(HEX64)),
        "envelope/reliability": _fine(e("reliability.source").isin(*"ABCDEF")) & _fine(e("reliability.information").isin(*"123456")),
        "envelope/custody": _fine(F.forall(e("custody"), lambda x: x["actor"].isNotNull() & x["at"].isNotNull())),
    }
    known = sorted(f for x in families for f in x.flags)
    if "flags" in columns:
        names = F.array(*[F.lit(f) for f in known]) if known else F.array().cast("array<string>")
        out["flags"] = _fine((F.size("flags") > 0) & (F.size(F.array_except("flags", names)) == 0) & ~F.exists("flags", lambda x: x.isNull()) & (F.size(F.array_distinct("flags")) == F.size("flags")))
    for metric in sorted(m for f in families for m in f.metrics):
        value = F.col(f"metrics.`{metric}`")
        out[f"metrics/{metric}"] = _sure(value.between(0, 1) if metric.startswith("int.") else value >= 0)
    if "markings_parsed" in columns:
        out["markings_parsed/level"] = _fine(F.col("markings_parsed.level").isin(*mk.LEVELS))
        out["markings_parsed/marked"] = F.col("markings_parsed.marked").isNotNull()
    return out


def broken(records: DataFrame, families: list[Family]) -> DataFrame:
    """(field, records): how many records break each condition; all conditions, from one aggregate."""
    wanted = conditions(families, records.columns)
    counts = records.agg(*[F.count_if(~c).alias(f"c{k}") for k, c in enumerate(wanted.values())])
    cells = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"c{k}").alias("records")) for k, name in enumerate(wanted)])
    return counts.select(F.explode(cells).alias("x")).select("x.*")


def checked(records: DataFrame, families: list[Family]) -> DataFrame:
    """records, or RecordError."""
    bad = broken(records, families).where("records > 0").orderBy("field").collect()  # one row for each condition at most
    if bad:
        raise RecordError("; ".join(f"{r['field']}: {r['records']} record(s)" for r in bad))
    return records
