"""Documents to records and corpus results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import __version__
from ..operators.families import REGISTRY, WHOLE, Family, count
from ..operators.quantiles import distributions


@dataclass
class Measured:
    """docs: the input with all families' columns and without texts, cached. results: in the order of the families."""

    docs: DataFrame
    families: list[Family]
    results: list[dict]
    pins: dict[str, str]

    @property
    def flags(self) -> list[str]:
        return sorted(f for x in self.families for f in x.flags)


def select_families(names: list[str] | None = None, config: dict[str, dict] | None = None) -> list[Family]:
    config = config or {}
    return [REGISTRY[n].with_config(**config[n]) if n in config else REGISTRY[n] for n in names or list(REGISTRY)]


def extend(docs: DataFrame, families: list[Family]) -> DataFrame:
    """One projection for what a document tells by itself, then each family's own joins."""
    columns: dict[str, Column] = {}
    for f in families:
        columns |= f.columns()
    out = docs.withColumns(columns) if columns else docs
    for f in families:
        out = f.extend(out)
    return out


def measure(docs: DataFrame, names: list[str] | None = None, config: dict[str, dict] | None = None) -> Measured:
    families = select_families(names, config)
    # Families with results() of their own may look at texts.
    shared = all(type(f).results is Family.results for f in families)
    full = extend(docs, families)
    full = (full.drop("text") if shared else full).persist()
    counts = count(families, full)
    spreads = distributions(full, {m: s for f in families for m, s in f.spreads().items()}, WHOLE)
    results, pins = [], {}
    for f in families:
        results += f.report(counts[f.name], spreads, full) if type(f).results is Family.results else f.results(full)
        pins |= f.pins
        pins[f"family:{f.name}"] = f.version
    return Measured(full, families, results, pins)


def flag_array(flags: list[str]) -> Column:
    """The names of the flags that hold, sorted; null if none does."""
    found = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in sorted(flags)])) if flags else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, found)


def records(m: Measured) -> DataFrame:
    """One row per document: doc_hash, envelope, metrics, flags, markings_parsed; ordered by hash and locator."""
    e = lambda c: F.col(c).alias(c)
    envelope = F.struct(
        e("adapter"), e("collected_at"), e("custody"), e("doc_hash"), F.lit("sha256").alias("hash_alg"), e("ingested_at"), e("markings"), e("media_type"),
        e("parent_hash"), e("reliability"), e("size_bytes"), e("source_id"), e("source_locator"), e("source_system"),
    )
    names = sorted(x for f in m.families for x in f.metrics)
    metrics = F.struct(*[F.col(f"`{n}`").alias(n) for n in names]) if names else F.from_json(F.lit("{}"), "struct<>")
    cols = [F.col("doc_hash"), envelope.alias("envelope"), flag_array(m.flags).alias("flags")]
    if any(f.name == "markings" for f in m.families):
        p = lambda n: F.col(f"markings_parsed.{n}").alias(n)
        cols.append(F.struct(*[p(n) for n in ("banner", "banners", "conflict", "controls", "level", "marked", "portion_max", "portions", "redaction_residue")]).alias("markings_parsed"))
    return m.docs.select(*cols, metrics.alias("metrics")).orderBy("doc_hash", F.split("envelope.source_locator", "/"))


def ranked_evidence(docs: DataFrame, flags: list[str], limit: int) -> DataFrame:
    """flag, doc_hash, place: the first hashes, in record order, of documents with each flag.

    Distinct hashes are cut to limit within their own partition before they meet.
    """
    rows = docs.select("doc_hash", F.explode(flag_array(flags)).alias("flag")).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("flag").orderBy("doc_hash"))).where(F.col("place") <= limit)


def engine() -> str:
    import pyspark

    return f"docgauge/{__version__} pyspark-{pyspark.__version__}"
