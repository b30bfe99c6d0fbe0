"""The metric families. Each adds columns to documents (flags as booleans, metrics) and turns them into results.

The columns of all families are one projection, their counters one aggregate, their distributions one count of values. Exact
duplicates, near duplicates, conflicting ids and histograms are plans of their own over the same frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markings as mk
from ..functions import text as tx
from ..model import rate, result
from .near import BANDS, ROWS, SLOTS, THRESHOLD, Neighbours, near_hashes
from .quantiles import Spread, distributions


@dataclass(frozen=True)
class Keyed:
    """A flag that depends on other documents: it holds for all documents of a group by keys (those with where) for which holds is true.

    holds may use c, the group's number of documents, and low and high, its least and largest hash.
    """

    keys: tuple[str, ...]
    holds: Column
    where: Column | None = None


def share(counter: str, of: str = "n", none: float | None = 0.0) -> Column:
    """A rate of counters; none of nothing."""
    return F.when(F.col(of) > 0, tx.round6(F.col(counter) / F.col(of))).otherwise(F.lit(none))


@dataclass(frozen=True)
class Family:
    """name, version and pins identify how a number was made.

    A family of one's own gives columns() or extend(), and either results(), or counters(), spreads() and report(), which share
    the measuring run's aggregates.
    """

    name: str = ""
    version: str = "0.1.0"
    pins: dict = field(default_factory=dict)
    flags: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()

    def columns(self) -> dict[str, Column]:
        return {}

    def extend(self, docs: DataFrame) -> DataFrame:
        return docs

    def local(self, docs: DataFrame) -> DataFrame:
        """docs with the columns that a document gives by itself."""
        return docs.withColumns(self.columns()) if self.columns() else docs

    def keyed(self) -> dict[str, Keyed]:
        """The flags that scopes count anew, because they depend on which other documents there are."""
        return {}

    def compared(self, docs: DataFrame) -> dict[str, Neighbours]:
        """The flags for which scopes compare texts anew."""
        return {}

    def compared_scalars(self) -> dict[str, Column]:
        """Each metric that is one number, from these flags."""
        return {}

    def counters(self) -> dict[str, Column]:
        """What is counted over all documents; n, their number, always is."""
        return {f: F.count_if(F.col(f)) for f in self.flags}

    def scalars(self) -> dict[str, Column]:
        """Each metric that is one number, from the counters."""
        return {}

    def spreads(self) -> dict[str, Spread]:
        """Each metric that is a distribution over documents."""
        return {}

    def report(self, c: dict, spreads: dict, docs: DataFrame) -> list[dict]:
        """The results, from the counters' values, the distributions and the extended documents."""
        return []

    def results(self, docs: DataFrame) -> list[dict]:
        return self.report(count([self], docs)[self.name], distributions(docs, self.spreads(), WHOLE), docs)

    def with_config(self, **options) -> "Family":
        raise AttributeError(f"family {self.name!r} takes no configuration")


#: Metrics whose values are whole numbers.
WHOLE = ("cnt.token_count",)


def count(families: list[Family], docs: DataFrame) -> dict[str, dict]:
    """The counters of each family, all from one aggregate."""
    named = [(f.name, k, c) for f in families for k, c in f.counters().items()]
    row = docs.agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"c{i}") for i, (_, _, c) in enumerate(named)]).first()
    out: dict[str, dict] = {f.name: {"n": row["n"]} for f in families}
    for i, (name, k, _) in enumerate(named):
        out[name][k] = row[f"c{i}"]
    return out


@dataclass(frozen=True)
class Duplication(Family):
    name: str = "duplication"
    version: str = "0.2.0-sha1minhash"
    pins: dict = field(default_factory=lambda: {"minhash": f"slots={SLOTS},bands={BANDS}x{ROWS},threshold={THRESHOLD},family=sha1/1"})
    flags: tuple[str, ...] = ("exact_duplicate", "near_duplicate")

    def extend(self, docs: DataFrame) -> DataFrame:
        repeated = docs.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("doc_hash", F.lit(True).alias("exact_duplicate"))
        near = near_hashes(docs.select("doc_hash", "text")).select("doc_hash", F.lit(True).alias("near_duplicate"))
        out = docs.join(repeated, "doc_hash", "left").join(near, "doc_hash", "left")
        return out.fillna(False, ["exact_duplicate", "near_duplicate"])

    def local(self, docs: DataFrame) -> DataFrame:
        return docs

    def keyed(self) -> dict[str, Keyed]:
        return {"exact_duplicate": Keyed(("doc_hash",), F.col("c") > 1)}

    def compared(self, docs: DataFrame) -> dict[str, Neighbours]:
        return {"near_duplicate": Neighbours(docs.select("doc_hash", "text"))}

    def compared_scalars(self) -> dict[str, Column]:
        return {"dup.near_count": F.col("near_duplicate"), "dup.near_rate": share("near_duplicate")}

    def scalars(self) -> dict[str, Column]:
        return {"dup.exact_count": F.col("exact_duplicate"), "dup.exact_rate": share("exact_duplicate")}

    def report(self, c: dict, spreads: dict, docs: DataFrame) -> list[dict]:
        out = []
        for flag, key in (("exact_duplicate", "exact"), ("near_duplicate", "near")):
            out += [result(f"dup.{key}_count", c[flag], self.version), result(f"dup.{key}_rate", rate(c[flag], c["n"]), self.version)]
        return out


@dataclass(frozen=True)
class Volume(Family):
    name: str = "volume"
    pins: dict = field(default_factory=lambda: {"token_estimate": f"chars/{tx.CHARS_PER_TOKEN}"})
    metrics: tuple[str, ...] = ("cnt.token_count",)

    def columns(self) -> dict[str, Column]:
        return {"cnt.token_count": tx.token_estimate(F.col("text"))}

    def counters(self) -> dict[str, Column]:
        return {"tokens": F.coalesce(F.sum("`cnt.token_count`"), F.lit(0))}

    def scalars(self) -> dict[str, Column]:
        return {"vol.total_docs": F.col("n"), "vol.total_tokens": F.col("tokens")}

    def spreads(self) -> dict[str, Spread]:
        return {"cnt.token_count": Spread((("p5", 0.05), ("p50", 0.5), ("p95", 0.95)), var=True, round_mean=False)}

    def report(self, c: dict, spreads: dict, docs: DataFrame) -> list[dict]:
        return [result("vol.total_docs", c["n"], self.version), result("vol.total_tokens", c["tokens"], self.version), result("cnt.token_count", None, self.version, spreads["cnt.token_count"])]


@dataclass(frozen=True)
class Integrity(Family):
    name: str = "integrity"
    version: str = "0.2.0-ownmojibake"
    large_bytes: int = tx.LARGE_BYTES
    flags: tuple[str, ...] = ("empty", "near_empty", "truncated", "mojibake", "control_chars", "markup_residue", "large")
    metrics: tuple[str, ...] = ("int.boilerplate_share", "int.intra_doc_repetition", "int.ngram_repetition")

    def columns(self) -> dict[str, Column]:
        t = F.col("text")
        return {
            "empty": tx.is_empty(t), "near_empty": tx.is_near_empty(t), "truncated": tx.is_truncated(t, mk.BANNER),
            "mojibake": tx.is_mojibake(t), "control_chars": tx.has_control_chars(t), "markup_residue": tx.has_markup(t),
            "large": F.col("size_bytes") > self.large_bytes,
            "int.boilerplate_share": tx.boilerplate_share(t), "int.intra_doc_repetition": tx.intra_doc_repetition(t), "int.ngram_repetition": tx.ngram_repetition(t),
        }

    def scalars(self) -> dict[str, Column]:
        rates = {"int.empty_rate": "empty", "int.near_empty_rate": "near_empty", "int.truncation_rate": "truncated", "int.mojibake_rate": "mojibake", "int.control_char_rate": "control_chars", "int.markup_residue_rate": "markup_residue", "int.large_rate": "large"}
        return {"int.empty_count": F.col("empty"), "int.large_count": F.col("large")} | {m: share(f) for m, f in rates.items()}

    def spreads(self) -> dict[str, Spread]:
        return {m: Spread((("p50", 0.5), ("p95", 0.95))) for m in self.metrics}

    def report(self, c: dict, spreads: dict, docs: DataFrame) -> list[dict]:
        r = lambda metric, flag: result(metric, rate(c[flag], c["n"]), self.version)
        out = [result("int.empty_count", c["empty"], self.version), r("int.empty_rate", "empty"), r("int.near_empty_rate", "near_empty"), r("int.truncation_rate", "truncated")]
        out += [r("int.mojibake_rate", "mojibake"), r("int.control_char_rate", "control_chars"), r("int.markup_residue_rate", "markup_residue")]
        out += [result("int.large_count", c["large"], self.version), r("int.large_rate", "large")]
        return out + [result(m, None, self.version, spreads[m]) for m in self.metrics]


@dataclass(frozen=True)
class Markings(Family):
    name: str = "markings"
    ceiling: str | None = None
    flags: tuple[str, ...] = ("unmarked", "marking_conflict", "ceiling_breach", "redaction_residue")

    def with_config(self, ceiling: str | None = None) -> "Markings":
        if ceiling is not None and ceiling not in mk.LEVELS:
            raise ValueError(f"unknown level {ceiling!r}; levels are {', '.join(mk.LEVELS)}")
        return replace(self, ceiling=ceiling, pins={"markings": f"ceiling={ceiling}"})

    def extend(self, docs: DataFrame) -> DataFrame:
        out = mk.with_marks(docs, "markings_parsed", "text", "markings")
        p = lambda f: F.col(f"markings_parsed.{f}")
        return out.withColumns({"unmarked": ~p("marked"), "marking_conflict": p("conflict"), "ceiling_breach": mk.above(p("level"), self.ceiling), "redaction_residue": p("redaction_residue")})

    def local(self, docs: DataFrame) -> DataFrame:
        return self.extend(docs)

    def scalars(self) -> dict[str, Column]:
        coverage = F.when(F.col("n") > 0, tx.round6((F.col("n") - F.col("unmarked")) / F.col("n"))).otherwise(0.0)
        breach = F.lit(None).cast("double") if self.ceiling is None else F.col("ceiling_breach")
        return {"mark.coverage": coverage, "mark.conflict_rate": share("marking_conflict"), "mark.ceiling_breach": breach, "mark.redaction_residue_rate": share("redaction_residue")}

    def report(self, c: dict, spreads: dict, docs: DataFrame) -> list[dict]:
        return [
            result("mark.coverage", rate(c["n"] - c["unmarked"], c["n"]), self.version),
            result("mark.conflict_rate", rate(c["marking_conflict"], c["n"]), self.version),
            result("mark.ceiling_breach", None if self.ceiling is None else c["ceiling_breach"], self.version),
            result("mark.redaction_residue_rate", rate(c["redaction_residue"], c["n"]), self.version),
        ]


@dataclass(frozen=True)
class Provenance(Family):
    name: str = "provenance"
    flags: tuple[str, ...] = ("undated", "duplicate_source_id")

    def extend(self, docs: DataFrame) -> DataFrame:
        has_id = F.coalesce(F.col("source_id"), F.lit("")) != ""
        ids = docs.where(has_id).groupBy("source_system", "source_id").agg(F.min("doc_hash").alias("__a"), F.max("doc_hash").alias("__z")).where("__a <> __z")
        ids = ids.select("source_system", "source_id", F.lit(True).alias("duplicate_source_id"))
        out = docs.withColumn("undated", F.coalesce(F.col("collected_at"), F.lit("")) == "").join(ids, ["source_system", "source_id"], "left")
        return out.fillna(False, ["duplicate_source_id"])

    def local(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("undated", F.coalesce(F.col("collected_at"), F.lit("")) == "")

    def keyed(self) -> dict[str, Keyed]:
        return {"duplicate_source_id": Keyed(("source_system", "source_id"), F.col("low") != F.col("high"), F.coalesce(F.col("source_id"), F.lit("")) != "")}

    def counters(self) -> dict[str, Column]:
        dated = F.when(~F.col("undated"), F.col("collected_at"))
        rated = F.col("reliability.source").isNotNull() | F.col("reliability.information").isNotNull()
        return super().counters() | {
            "lo": F.min(dated), "hi": F.max(dated), "dated": F.count(dated), "custody": F.count_if(F.size("custody") > 0), "rated": F.count_if(rated),
            "derived": F.count_if(F.coalesce(F.col("parent_hash"), F.lit("")) != ""), "with_id": F.count_if(F.coalesce(F.col("source_id"), F.lit("")) != ""),
        }

    def scalars(self) -> dict[str, Column]:
        return {
            "prov.undated_rate": share("undated"), "prov.custody_complete_rate": share("custody"), "prov.derived_share": share("derived"),
            "prov.duplicate_id_count": F.col("duplicate_source_id"), "prov.duplicate_id_rate": share("duplicate_source_id", "with_id", None),
        }

    def report(self, c: dict, spreads: dict, docs: DataFrame) -> list[dict]:
        rel = F.concat(F.coalesce("reliability.source", F.lit("?")), F.coalesce("reliability.information", F.lit("?")))
        rated = F.col("reliability.source").isNotNull() | F.col("reliability.information").isNotNull()
        sources = docs.groupBy("source_system").agg(F.count(F.lit(1)).alias("docs"), F.sum("size_bytes").alias("bytes")).orderBy("source_system").collect()
        letters = docs.where(rated).groupBy(rel.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()
        v = self.version
        return [
            result("prov.source_histogram", {r["source_system"]: {"docs": r["docs"], "bytes": r["bytes"]} for r in sources}, v),
            result("prov.date_range", {"min": c["lo"], "max": c["hi"], "dated": c["dated"]} if c["dated"] else None, v),
            result("prov.undated_rate", rate(c["undated"], c["n"]), v),
            result("prov.custody_complete_rate", rate(c["custody"], c["n"]), v),
            result("prov.reliability_histogram", {**{r["k"]: r["n"] for r in letters}, "unrated": c["n"] - c["rated"]}, v),
            result("prov.derived_share", rate(c["derived"], c["n"]), v),
            result("prov.duplicate_id_count", c["duplicate_source_id"], v),
            result("prov.duplicate_id_rate", rate(c["duplicate_source_id"], c["with_id"]) if c["with_id"] else None, v),
        ]


REGISTRY: dict[str, Family] = {}


def register(family: Family) -> Family:
    """Make a family available by name; own families follow the same contract."""
    REGISTRY[family.name] = family
    return family


for _family in (Duplication(), Volume(), Integrity(), Markings(), Provenance()):
    register(_family)
