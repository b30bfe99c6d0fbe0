"""Personal data in texts: candidates by pattern, proven by checksums or shape, never stored.

A candidate is a maximal run of a kind's characters, so a number inside of a longer one is none. Cards must pass Luhn's
check and IBANs the remainder by 97, both folds over their characters; addresses and numbers must have the shape their kind
demands. Where spans of two kinds overlap a sweep from the left keeps the first, the longer one of equal starts,
and then the one whose kind comes first. Spans are places: start and end in code points.

Defined cases: a null text has no spans; texts of any length are read whole, and however many spans they hold; a repeated row has
its own; further columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import apart, let, matches
from ..model import rate, result
from .families import Family

# Patterns of candidates. Kinds in the order in which ties are resolved.
PATTERNS = {
    "iban": "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "card": "[0-9](?:[ -]?[0-9]){12,}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ssn": "[0-9]+(?:-[0-9]+)+",
    "ipv4": r"[0-9]+(?:\.[0-9]+)+",
    "phone": r"\+[0-9](?:[ ()-]?[0-9]){7,}",
}
KINDS = tuple(PATTERNS)
SPAN = "struct<start:bigint,longer:bigint,kind:int,end:bigint>"
#: Kinds that tell of persons of the United States.
US_KINDS = ("ssn",)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of a text pass Luhn's check."""
    reverse = F.reverse(F.split(digits(text), ""))
    worth = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """The remainder by 97 of an account number, its first four characters moved to its end and letters written as numbers from 10."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (F.when(c <= "9", a * 10).otherwise(a * 100) + value(c)) % 97)


def proven(kind: str, found: Column) -> Column:
    """Whether a candidate is what its pattern promises."""
    n = F.length(digits(found))
    if kind == "iban":
        return F.length(F.replace(found, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(found) == 1)
    if kind == "card":
        return n.between(13, 19) & luhn(found) & found.rlike("[1-9]")
    if kind == "ssn":
        return found.rlike("^(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})$")
    if kind == "ipv4":
        return found.rlike("^(?:(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:[.]|$)){4}$") & ~F.endswith(found, F.lit("."))
    if kind == "phone":
        return n.between(8, 15)
    return F.length(found) <= 254


#: What a text must hold for a candidate, where that is cheaper to see than the pattern.
HINTS = {"email": "@", "ssn": "-", "ipv4": ".", "phone": "+"}


def pii_spans(text: Column) -> Column:
    """The spans of a text in order: start, kind (its place in KINDS) and end; longer orders them."""

    def of(k: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: proven(kind, m["found"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("longer"), F.lit(k).alias("kind"), m["end"].alias("end")))
        hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
        return F.coalesce(F.when(hint, spans), F.array().cast(f"array<{SPAN}>"))

    every = F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))
    return let(every, lambda x: apart(x, SPAN))


def kind_name(kind: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in KINDS]), kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(F.coalesce(F.col(text_col), F.lit("")))).alias("t"))
    rows = rows.select("doc_id", pii_spans(F.col("t")).alias("s"))
    return rows.select("doc_id", F.transform("s", lambda x: F.struct(kind_name(x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


@dataclass(frozen=True)
class Pii(Family):
    """Hit rate, entities by category, and the rate of US-person indicators. Not registered by itself."""

    name: str = "pii"
    version: str = "0.1.0-checked"
    us_kinds: tuple[str, ...] = US_KINDS
    flags: tuple[str, ...] = ("has_pii", "us_person")

    def extend(self, docs: DataFrame) -> DataFrame:
        own = docs.withColumn("pii_spans", pii_spans(F.coalesce(F.col("text"), F.lit(""))))
        named = F.transform("pii_spans", lambda x: kind_name(x["kind"]))
        return own.withColumns({"pii_kinds": named, "has_pii": F.size("pii_spans") > 0, "us_person": F.arrays_overlap(named, F.array(*[F.lit(k) for k in self.us_kinds]))}).drop("pii_spans")

    def local(self, docs: DataFrame) -> DataFrame:
        return self.extend(docs)

    def counters(self) -> dict[str, Column]:
        of = lambda k: F.sum(F.size(F.filter("pii_kinds", lambda x: x == k)))
        return super().counters() | {f"of_{k}": F.coalesce(of(k), F.lit(0)) for k in KINDS}

    def report(self, c: dict, spreads: dict, docs: DataFrame) -> list[dict]:
        v = self.version
        return [result("pii.hit_rate", rate(c["has_pii"], c["n"]), v), result("pii.by_category", {k: c[f"of_{k}"] for k in KINDS}, v), result("pii.usp_indicator_rate", rate(c["us_person"], c["n"]), v)]
