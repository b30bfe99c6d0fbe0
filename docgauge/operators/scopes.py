"""Metrics for parts of the corpus: by source, language, month, or several of these at once.

All scopes are counted together by grouping sets. Each document's flags are computed once and expanded to its scopes as narrow rows, which
are added up before they are shuffled, so a scope that holds most documents is no hot key. Flags that depend on other documents (copies,
conflicting ids) are counted anew in each scope, in two steps: by scope and key, then by scope. Distributions come from the counts of each scope's
values. What is told of a scope equals a run over its documents alone. If asked for, near duplicates are too: signatures are made once, and those of
documents that are near another of the corpus are compared again within each scope.

Defined cases: a scope whose value is null is named by its column alone; ``%``, ``=`` and ``,`` in values are written %25, %3D and %2C; scopes exist
where documents do, so an empty table has none, not even that of all; a rate of nothing is what it is for an empty corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .families import Family
from .near import Neighbours
from .quantiles import described, value_counts

ALL = "all"


def _value(column: str) -> Column:
    out = F.col(column).cast("string")
    for mark, told in (("%", "%25"), ("=", "%3D"), (",", "%2C")):
        out = F.replace(out, F.lit(mark), F.lit(told))
    return out


def label(columns: list[str]) -> Column:
    """A scope's name inside an aggregate by grouping sets."""
    parts = [F.when(F.grouping(c) == 0, F.concat(F.lit(c), F.coalesce(F.concat(F.lit("="), _value(c)), F.lit("")))) for c in columns]
    name = F.concat_ws(",", *parts)
    return F.when(name == "", F.lit(ALL)).otherwise(name)


def scoped(docs: DataFrame, families: list[Family], scopes: list[list[str]], compare: bool = False) -> DataFrame:
    """(scope, metric_id, key, value): key is ``value`` for single numbers, else the distribution's number. scopes are sets of columns of docs.

    compare: with what comes from comparing the texts of a scope (near duplicates).
    """
    columns = sorted({c for s in scopes for c in s})
    rows = reduce(lambda d, f: f.local(d), families, docs)
    keyed = {f"{f.name}__{flag}": k for f in families for flag, k in f.keyed().items()}
    # Keyed flags and those that compare texts are counted below.
    counters = {f"{f.name}__{k}": c for f in families for k, c in f.counters().items() if k not in f.keyed() and (k not in f.flags or k in rows.columns)}
    # Texts are looked at once; all that follows reads these narrow rows.
    narrow = settled(rows.drop("text"))
    told = narrow.groupingSets(scopes, *columns).agg(label(columns).alias("scope"), F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counters.items()]).drop(*columns)
    for name, k in keyed.items():
        mine = narrow if k.where is None else narrow.where(k.where)
        keys = [f"__{c}" for c in k.keys]
        mine = mine.select(*columns, "doc_hash", *[F.col(c).alias(f"__{c}") for c in k.keys])
        groups = mine.groupingSets([[*s, *keys] for s in scopes], *columns, *keys).agg(
            label(columns).alias("scope"), F.count(F.lit(1)).alias("c"), F.min("doc_hash").alias("low"), F.max("doc_hash").alias("high")
        )
        told = told.join(groups.groupBy("scope").agg(F.sum(F.when(k.holds, F.col("c")).otherwise(0)).alias(name)), "scope", "left").fillna(0, [name])
    for name, near in ({f"{f.name}__{flag}": n for f in families for flag, n in f.compared(docs).items()} if compare else {}).items():
        told = told.join(_compared(narrow.join(near.corpus, "doc_hash", "left_semi"), near, scopes, columns).withColumnRenamed("c", name), "scope", "left").fillna(0, [name])
    out = _values(settled(told), families, compare)
    spreads = {m: s for f in families for m, s in f.spreads().items()}
    if spreads:
        counts = settled(value_counts(narrow, list(spreads), scopes, label(columns)))
        out = out.unionByName(described(counts, spreads).select("scope", "metric_id", "key", "value"))
    return out


def _compared(narrow: DataFrame, near: Neighbours, scopes: list[list[str]], columns: list[str]) -> DataFrame:
    """(scope, c): how many of each scope's documents have a neighbour in it, from the rows that have one in the corpus."""
    out = narrow.agg(F.lit(ALL).alias("scope"), F.count(F.lit(1)).alias("c"))
    parts = [s for s in scopes if s]
    if not parts:
        return out
    groups = narrow.groupingSets([[*s, "doc_hash"] for s in parts], *columns, "doc_hash").agg(label(columns).alias("scope"), F.count(F.lit(1)).alias("c"))
    members = settled(groups.select("scope", "doc_hash", "c"))
    inside = members.join(near.inside(members.select("scope", "doc_hash")), ["scope", "doc_hash"], "left_semi")
    return out.unionByName(inside.groupBy("scope").agg(F.sum("c").alias("c")))


def _values(told: DataFrame, families: list[Family], compare: bool) -> DataFrame:
    """A row for each scalar metric of each scope."""
    out = None
    for f in families:
        scalars = f.scalars() | (f.compared_scalars() if compare else {})
        if not scalars:
            continue
        own = told.select("scope", "n", *[F.col(f"`{c}`").alias(c.removeprefix(f"{f.name}__")) for c in told.columns if c.startswith(f"{f.name}__")])
        cells = F.array(*[F.struct(F.lit(m).alias("metric_id"), v.cast("double").alias("value")) for m, v in scalars.items()])
        rows = own.select("scope", F.explode(cells).alias("x")).select("scope", "x.metric_id", F.lit("value").alias("key"), "x.value")
        out = rows if out is None else out.unionByName(rows)
    return out
