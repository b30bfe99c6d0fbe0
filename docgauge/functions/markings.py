"""Handling markings in plain text: banner lines, portion marks, redaction residue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LINE_BREAK, SPACE, strip

# Levels from lowest to highest, the words that name them, and the forms of marks.
LEVELS = ["U", "CUI", "C", "S", "TS"]
LEVEL_WORDS = {
    "UNCLASSIFIED": "U",
    "CONTROLLED UNCLASSIFIED INFORMATION": "CUI",
    "CUI": "CUI",
    "CONFIDENTIAL": "C",
    "SECRET": "S",
    "TOP SECRET": "TS",
}
_WORDS = "TOP SECRET|SECRET|CONFIDENTIAL|UNCLASSIFIED|CONTROLLED UNCLASSIFIED INFORMATION|CUI"
BANNER = rf"^[{SPACE}]*({_WORDS})(//[A-Z0-9][A-Z0-9 ,/\-]*)?[{SPACE}]*$"
PORTION = rf"^[{SPACE}]*(?:[-*•][{SPACE}]*|\p{{Nd}}+[.)][{SPACE}]*)?\((U|CUI|C|S|TS)(//[A-Z0-9][A-Z0-9 ,/\-]*?)?\)"
INLINE = rf"(?<![\p{{L}}\p{{N}}_])({_WORDS})//[A-Z][A-Z0-9 ,/\-]*"
REDACTION = r"(?iu)\[(?:REDACTED|DELETED|WITHHELD|REMOVED)\]|\(b\)\(\p{Nd}\)(?:\([A-Za-z]\))?|[█■]{3,}|(?<![\p{L}\p{N}_])X{6,}(?![\p{L}\p{N}_])"


def _rank(level: Column) -> Column:
    """0 for the lowest level; null for none."""
    at = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)
    return F.when(at > 0, at - 1)


def level_at(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LEVELS]), rank.cast("int"))


def above(level: Column, ceiling: str | None) -> Column:
    """Strictly above the ceiling; false where either is missing."""
    if ceiling is None:
        return F.lit(False)
    return F.coalesce(_rank(level) > LEVELS.index(ceiling), F.lit(False))


#: Whatever a mark of any kind must contain; a line without it needs no other test.
HINT = rf"{_WORDS}|\((?:U|CUI|C|S|TS)(?://|\))|(?iu:\[(?:REDACTED|DELETED|WITHHELD|REMOVED)\]|\(b\)\(|[█■]{{3}}|X{{6}})"


def _marks(rows: Column) -> Column:
    """What each line has: the word and the rest of a banner, or a portion mark and residue. Each pattern is tried once."""

    def one(x: Column) -> Column:
        word = F.regexp_extract(x, BANNER, 1)
        return F.struct(word.alias("word"), F.regexp_extract(x, BANNER, 2).alias("more"), strip(x).alias("line"), F.regexp_extract(x, PORTION, 1).alias("portion"), (x.rlike(REDACTION) | x.rlike(INLINE)).alias("residue"))

    return F.transform(rows, one)


def _once(docs: DataFrame, **columns: Column) -> DataFrame:
    """More columns, each computed once however often it is used: a generator of one row, which the optimizer doesn't see through."""
    for name, c in columns.items():
        docs = docs.select("*", F.explode(F.array(c)).alias(name))
    return docs


def with_marks(docs: DataFrame, out: str, text_col: str = "text", markings_col: str | None = None) -> DataFrame:
    """docs with a struct: banner, banners, controls, portions, portion_max, level, marked, conflict, redaction_residue.

    Texts without a hint of a mark are not split; of the others only lines with one are looked at.
    """
    text, none = F.col(text_col), F.array().cast("array<string>")
    hinted = F.when(text.rlike(HINT), F.filter(F.split(text, LINE_BREAK), lambda x: x.rlike(HINT))).otherwise(none)
    told = F.coalesce(F.col(markings_col), none) if markings_col else none
    rows = _once(docs, __marks=F.concat(_marks(hinted), _marks(F.filter(told, lambda x: x.rlike(BANNER)))))
    banner = lambda m: m["word"] != ""
    banners, others = F.filter("__marks", banner), F.filter("__marks", lambda m: ~banner(m))
    level_of = F.create_map(*[F.lit(x) for k, v in LEVEL_WORDS.items() for x in (k, LEVELS.index(v))])
    place_of = F.create_map(*[F.lit(x) for k, v in enumerate(LEVELS) for x in (v, k)])
    rows = _once(
        rows,
        __lines=F.array_distinct(F.transform(banners, lambda m: m["line"])),
        __levels=F.array_distinct(F.transform(banners, lambda m: F.element_at(level_of, m["word"]))),
        __portions=F.transform(F.filter(others, lambda m: m["portion"] != ""), lambda m: F.element_at(place_of, m["portion"])),
    )
    top, portion_top = F.array_max("__levels"), F.array_max("__portions")
    doc_top = F.greatest(top, portion_top)
    parts = F.flatten(F.transform(banners, lambda m: F.transform(F.split(m["more"], "//"), strip)))
    counts = [F.struct(F.lit(v).alias("level"), F.size(F.filter("__portions", _is(k))).cast("long").alias("n")) for k, v in enumerate(LEVELS)]
    parsed = F.struct(
        level_at(top).alias("banner"),
        F.col("__lines").alias("banners"),
        F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))).alias("controls"),
        F.map_from_entries(F.filter(F.array(*counts), lambda x: x["n"] > 0)).alias("portions"),
        level_at(portion_top).alias("portion_max"),
        level_at(doc_top).alias("level"),
        doc_top.isNotNull().alias("marked"),
        F.coalesce((F.size("__levels") > 1) | (top != portion_top), F.size("__levels") > 1).alias("conflict"),
        F.exists(others, lambda m: m["residue"]).alias("redaction_residue"),
    )
    return rows.withColumn(out, parsed).drop("__marks", "__lines", "__levels", "__portions")


def _is(value: int):
    """A predicate of array functions, which take functions of the element alone."""

    def same(x: Column) -> Column:
        return x == value

    return same
