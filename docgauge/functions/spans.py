"""Places in texts as Column expressions: matches with their offsets, and the choice among spans that overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded at once. A fold that appends copies what it has, so long arrays are folded block by block.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it, also inside functions of each element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def blocks(values: Column) -> Column:
    """An array that is not empty, cut into arrays of BLOCK elements."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
    return let(values, cut)


def sums_before(lengths: Column) -> Column:
    """For each of an array of longs the sum of all earlier ones."""
    zero = F.lit(0).cast("long")

    def sums(block: Column) -> Column:
        start = F.struct(zero.alias("total"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(block, start, lambda a, v: F.struct((a["total"] + v).alias("total"), F.concat(a["out"], F.array(a["total"])).alias("out")))

    start = F.struct(zero.alias("total"), F.array().cast("array<array<bigint>>").alias("out"))
    joined = F.aggregate(
        F.transform(blocks(lengths), sums), start,
        lambda a, b: F.struct((a["total"] + b["total"]).alias("total"), F.concat(a["out"], F.array(F.transform(b["out"], lambda v: v + a["total"]))).alias("out")),
    )
    return F.flatten(joined["out"])


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches from left to right as structs: start and end in code points, and the group's string; null if there are none."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), found(0).alias("found"), found(group).alias("told"))

    def spans(p: Column) -> Column:
        both = F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["found"])), p["found"], lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        return let(
            sums_before(both),
            lambda before: F.transform(
                p["found"],
                lambda m, i: F.struct(
                    (F.get(before, i) + F.length(F.get(p["gaps"], i))).alias("start"),
                    (F.get(before, i) + F.length(F.get(p["gaps"], i)) + F.length(m)).alias("end"),
                    F.get(p["told"], i).alias("found"),
                ),
            ),
        )

    return F.when(text.rlike(pattern), let(parts, spans))


def apart(spans: Column, kind: str) -> Column:
    """Of sorted spans (structs of type kind, with start and end) those that a sweep from the left keeps: each begins where the last one kept has ended."""
    none, far = F.array().cast(f"array<{kind}>"), F.lit(-1).cast("long")

    def step(a: Column, x: Column) -> Column:
        free = x["start"] >= a["end"]
        return F.struct(F.when(free, x["end"]).otherwise(a["end"]).alias("end"), F.when(free, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))

    def whole(a: Column, block: Column) -> Column:
        return let(F.aggregate(block, F.struct(a["end"].alias("end"), none.alias("out")), step), lambda b: F.struct(b["end"].alias("end"), F.concat(a["out"], F.array(b["out"])).alias("out")))

    start = F.struct(far.alias("end"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(spans) > 0, F.flatten(F.aggregate(blocks(spans), start, whole)["out"])).otherwise(none)
