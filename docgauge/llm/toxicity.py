"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees the text's features and the
log odds of every earlier category. While fitting, those log odds come from models that
have not seen the row (out-of-fold), so a later model learns from predictions as good as
those it will get. Features are the presence of words and of five-letter beginnings of longer words,
chosen by their chi-square among those that speak for a category.

Fitting uses at most MAX_LABELLED labelled rows (those with the smallest id hash), of which the
driver gets the chosen features alone; scoring runs over every document and its whole text.

Defined cases: a null text has no features and gets the chain's base rates; labels with a
null are left out; several labels of an id count by their maximum; a category with one
class in the sample, or no labels at all, gives its constant rate; an empty table gives an
empty result; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, pin, read, text_of
from .memory import tidy

MAX_LABELLED = 12_000
#: Least chi-square of a feature with some category: chance alone reaches it about once in two million features.
LEVEL = 25.0
FOLDS = 5
STEM = 5
THRESHOLD = 0.5
#: Category: SQL condition over the columns of labels. The order is the chain's.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 AND quality = 0"}
REJECT = "toxic"

_WORD = re.compile(r"\w+")


def features_of(text: str) -> set[str]:
    """Words, and beginnings of words longer than STEM marked by a trailing star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


# --- the linear models (numpy, on the driver, over the bounded sample) ------


class Rows:
    """A sparse 0/1 matrix by rows."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.col], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.at], minlength=self.width)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(x: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, l2: float = 5e-5, steps: int = 250) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression over the rows in use by Adam; returns weights, dense weights and bias."""
    n, rate = max(1, use.sum()), float(y[use].mean()) if use.any() else 0.0
    rate = min(max(rate, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    theta = np.zeros(x.width + dense.shape[1] + 1)
    theta[-1] = math.log(rate / (1 - rate))
    if not use.any() or y[use].min() == y[use].max():
        return theta[: x.width], theta[x.width : -1], float(theta[-1])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = use / n
    for t in range(1, steps + 1):
        p = _sigmoid(x.dot(theta[: x.width]) + dense @ theta[x.width : -1] + theta[-1])
        r = (p - y) * weight
        g = np.concatenate([x.back(r) + l2 * theta[: x.width], r @ dense + l2 * theta[x.width : -1], [r.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.12 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[: x.width], theta[x.width : -1], float(theta[-1])


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, width: int) -> tuple[list, np.ndarray]:
    """One model for each column of labels, in order, and the out-of-fold probabilities."""
    x, n, k = Rows(rows, width), len(rows), labels.shape[1]
    dense, oof, models = np.zeros((n, 0)), np.zeros((n, k)), []
    for c in range(k):
        y, z = labels[:, c].astype(float), np.zeros(n)
        for f in np.unique(folds):
            w, d, b = fit_linear(x, dense, y, folds != f)
            z = np.where(folds == f, x.dot(w) + dense @ d + b, z)
        models.append(fit_linear(x, dense, y, np.ones(n, bool)))
        z = np.clip(z, -12, 12)
        oof[:, c] = _sigmoid(z)
        dense = np.column_stack([dense, z])
    return models, oof


class Chain:
    """Fitted chain: vocabulary, models in order, and the scores of a text."""

    def __init__(self, vocabulary: list[str], models: list, names: list[str], oof=None, labels=None):
        self.names, self.oof, self.labels = names, oof, labels
        table = np.array([w for w, _, _ in models]).T if vocabulary else np.zeros((0, len(models)))
        self.weights = {f: tuple(row) for f, row in zip(vocabulary, table.tolist())}
        self.chain = [(d.tolist(), b) for _, d, b in models]

    def score(self, text: str) -> list[float]:
        sums = [b for _, b in self.chain]
        for f in features_of(text) & self.weights.keys():
            for c, w in enumerate(self.weights[f]):
                sums[c] += w
        before: list[float] = []
        for c, (d, _) in enumerate(self.chain):
            z = sums[c] + sum(w * p for w, p in zip(d, before))
            before.append(min(12.0, max(-12.0, z)))
        return [1 / (1 + math.exp(-z)) for z in before]


# --- Spark ------------------------------------------------------------------


def _counts(k: int):
    def run(batches):
        found: list[Counter] = [Counter() for _ in range(k + 1)]
        for batch in batches:
            for text, *ys in zip(*[c.to_pylist() for c in batch.columns]):
                seen = features_of(text)
                found[0].update(seen)
                for c, y in enumerate(ys):
                    if y:
                        found[c + 1].update(seen)
        words = list(found[0])
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            cols = [pa.array(part, pa.string())] + [pa.array([f[w] for w in part], pa.int64()) for f in found]
            yield pa.RecordBatch.from_arrays(cols, names=["feature", *(f"n{c}" for c in range(k + 1))])

    return run


def _indices(vocabulary: list[str], k: int):
    place = {f: i for i, f in enumerate(vocabulary)}

    def run(batches):
        for batch in batches:
            cols = batch.columns
            at = [sorted(place[f] for f in features_of(t) & place.keys()) for t in cols[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), *cols[1:]], names=["at", *(f"y{c}" for c in range(k)), "fold"])

    return run


def _speaks_for(y: Column, pos: float, n: int) -> Column:
    """Whether a feature of n0 of n documents, y of them among the pos of a category, speaks for it at LEVEL (Yates)."""
    seen = F.col("n0")
    spread = seen * (n - seen) * F.lit(pos) * F.lit(n - pos)
    more = y * F.lit(float(n)) - seen * F.lit(pos) - F.lit(n / 2)
    return (spread > 0) & (more > 0) & (F.lit(float(n)) * more * more >= F.lit(LEVEL) * spread)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, max_labelled: int = MAX_LABELLED) -> Chain:
    """Fit the chain on at most max_labelled documents of labels (doc_id and the columns that categories name)."""
    categories = categories or CATEGORIES
    k = len(categories)
    ys = [f"y{c}" for c in range(k)]
    marked = labels.where("doc_id IS NOT NULL").select("doc_id", *[F.expr(f"CAST({e} AS INT)").alias(y) for y, e in zip(ys, categories.values())]).dropna()
    marked = marked.groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys])
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # the documented bound
    # The broadcast has at most max_labelled rows.
    sample = docs.select(F.col("doc_id").alias("id"), text_of().alias("text")).join(F.broadcast(marked), F.col("id") == F.col("doc_id"))
    sample = sample.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), *[F.first(y).alias(y) for y in ys])
    sample = pin(sample.select("id", F.col("t.text").alias("text"), *ys, F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int").alias("fold")))
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys]).first()
    n = totals["n"]
    counts = sample.select("text", *ys).mapInArrow(tidy(_counts(k)), ", ".join(["feature string", *(f"n{c} long" for c in range(k + 1))]))
    counts = counts.groupBy("feature").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in range(k + 1)])
    speaks = F.lit(False)
    for c, y in enumerate(ys):
        speaks = speaks | _speaks_for(F.col(f"n{c + 1}"), float(totals[y]), n)
    # As many as the sample's texts give; a word of a bounded sample is the unit here, not a document.
    vocabulary = sorted(r["feature"] for r in counts.where(speaks).select("feature").collect())
    kinds = ", ".join(["at array<int>", *(f"{y} int" for y in ys), "fold int"])
    rows = sample.orderBy("id").select("text", *ys, "fold").mapInArrow(tidy(_indices(vocabulary, k)), kinds).toArrow()
    at = [np.array(x, np.int64) for x in rows.column("at").to_pylist()]
    y = np.column_stack([rows.column(y).to_numpy() for y in ys]) if n else np.zeros((0, k))
    models, oof = fit_chain(at, y, rows.column("fold").to_numpy(), len(vocabulary))
    return Chain(vocabulary, models, list(categories), oof, y)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a probability p_<category> for every document."""
    arrow_limits(docs.sparkSession)
    names = [f"p_{c}" for c in chain.names]
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a row of weights for each feature of the sample

    def run(batches):
        model = shared.value
        for batch in batches:
            out = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in out], pa.float64()) for c in range(len(names)))], names=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), ", ".join([f"doc_id {kind}", *(f"{n} double" for n in names)]))


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, reject: str = REJECT) -> DataFrame:
    """The documents, all columns kept, whose probability of the reject category is below threshold."""
    arrow_limits(docs.sparkSession)
    at = chain.names.index(reject)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def chance(series):
        model = shared.value
        return series.map(lambda t: model.score(t)[at])

    return docs.where(F.pandas_udf(chance, "double")(text_of()) < threshold)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities and whether it is toxic."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.withColumn("is_toxic", F.col(f"p_{REJECT}") >= THRESHOLD)
