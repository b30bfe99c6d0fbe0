"""Distributions by the index rule: the value at floor(p * (n - 1)) of the sorted values, no interpolation.

All values of all metrics are counted in one aggregate, which is kept; everything else is drawn from the counts. Counted
values are dealt into buckets by their leading bits, so nothing is ordered but the values of a bucket and the buckets
of a metric, and no window spans a metric's values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled


@dataclass(frozen=True)
class Spread:
    """What is told of a metric's values: min, the points, max, mean and, if asked, the population variance."""

    points: tuple[tuple[str, float], ...]
    var: bool = False
    round_mean: bool = True


#: Steps of a power of two.
STEPS = 16


def bucket(v: Column) -> Column:
    """A whole number that never falls as v grows: sign, exponent and leading bits. Some thousand values at most."""
    size = F.abs(v)
    power = F.floor(F.log2(F.when(size > 0, size)))
    step = power * STEPS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * STEPS) + 1100 * STEPS
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * step).cast("long")


def value_counts(docs: DataFrame, metrics: list[str], scopes: list[list[str]] | None = None, label: Column | None = None) -> DataFrame:
    """(scope, metric_id, v, c): how often each value of each metric occurs, in each scope if sets of columns are given."""
    told = F.array(*[F.struct(F.lit(m).alias("metric_id"), F.col(f"`{m}`").cast("double").alias("v")) for m in metrics])
    columns = sorted({c for s in scopes or [] for c in s})
    rows = docs.select(*columns, F.explode(told).alias("x")).select(*columns, "x.*").where("v IS NOT NULL")
    n = F.count(F.lit(1)).alias("c")
    if scopes is None:
        return rows.groupBy(F.lit("all").alias("scope"), "metric_id", "v").agg(n)
    sets = [[*s, "metric_id", "v"] for s in scopes]
    return rows.groupingSets(sets, *columns, "metric_id", "v").agg(label.alias("scope"), n).select("scope", "metric_id", "v", "c")


def described(counts: DataFrame, spreads: dict[str, Spread]) -> DataFrame:
    """(scope, metric_id, key, value, n) for kept counts: a row for each number that spreads ask for."""
    at = counts.withColumn("b", bucket(F.col("v")))
    group = ["scope", "metric_id"]
    sums = at.groupBy(*group, "b").agg(F.sum("c").alias("m"))
    every = Window.partitionBy(*group)
    sums = sums.select(*group, "b", (F.sum("m").over(every.orderBy("b")) - F.col("m")).alias("before"), "m", F.sum("m").over(every).alias("n"))
    wanted = [F.struct(F.lit(m).alias("of"), F.lit(k).alias("key"), F.lit(float(p)).alias("p")) for m, s in spreads.items() for k, p in s.points]
    wanted += [F.struct(F.lit(m).alias("of"), F.lit(k).alias("key"), F.lit(p).alias("p")) for m in spreads for k, p in (("min", 0.0), ("max", 1.0))]
    points = sums.withColumn("w", F.explode(F.array(*wanted))).select(*group, "b", "before", "m", "n", "w.*").where("of = metric_id")
    rank = F.floor(F.col("p") * (F.col("n") - 1))
    points = points.where((rank >= F.col("before")) & (rank < F.col("before") + F.col("m"))).select(*group, "b", "key", "n", (rank - F.col("before")).alias("rank"))
    inside = at.join(points.select(*group, "b").distinct(), [*group, "b"], "left_semi")
    inside = inside.withColumn("upto", F.sum("c").over(Window.partitionBy(*group, "b").orderBy("v")))
    picked = points.join(inside, [*group, "b"]).where("upto > rank").groupBy(*group, "key", "n").agg(F.min("v").alias("value"))
    mean = counts.groupBy(*group).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    rounded = F.col("metric_id").isin([m for m, s in spreads.items() if s.round_mean])
    means = mean.select(*group, F.lit("mean").alias("key"), "n", F.when(rounded, F.bround("mean", 6)).otherwise(F.col("mean")).alias("value"))
    out = picked.select(*group, "key", "value", "n").unionByName(means.select(*group, "key", "value", "n"))
    with_var = [m for m, s in spreads.items() if s.var]
    if with_var:
        off = counts.where(F.col("metric_id").isin(with_var)).join(mean.select(*group, "n", "mean"), group)
        var = off.groupBy(*group, "n").agg(F.sum((F.col("v") - F.col("mean")) ** 2 * F.col("c")).alias("q"))
        out = out.unionByName(var.select(*group, F.lit("var").alias("key"), (F.col("q") / F.col("n")).alias("value"), "n"))
    return out


def _ordered(spread: Spread, found: dict) -> dict:
    """A distribution's numbers in the order in which they are told."""
    return {k: found[k] for k in ("min", *[k for k, _ in spread.points], "max", "mean", *(["var"] if spread.var else []))}


def distributions(docs: DataFrame, spreads: dict[str, Spread], whole: tuple[str, ...] = ()) -> dict[str, dict | None]:
    """The distribution of each metric, None where it has no values; docs is read once. Metrics in whole are whole numbers."""
    if not spreads:
        return {}
    counts = settled(value_counts(docs, list(spreads)))
    found: dict[str, dict] = {}
    for r in described(counts, spreads).collect():  # a few rows for each metric
        number = int(r["value"]) if r["metric_id"] in whole and r["key"] not in ("mean", "var") else r["value"]
        found.setdefault(r["metric_id"], {})[r["key"]] = number
    return {m: _ordered(s, found[m]) if m in found else None for m, s in spreads.items()}
