"""The languages and scripts of documents.

Languages: a naive Bayes model of letter trigrams, counted over all documents whose language is known. Trigrams fall into
BUCKETS cells by a polynomial of their code points, so a model is a table of languages times BUCKETS whole numbers, whatever the corpus;
scoring looks cells up in it, joins nothing and moves no row. Texts are scored in pieces of PIECE trigrams, which are added up to documents: a
document's label is the best of all its trigrams, its mixture what its pieces say one by one.

Scripts: a text's letters fall into runs of one script; a code point's script is found among sorted ranges by a binary search written as
nested conditions. A word of two scripts is told apart from words of either.

Defined cases: a text with fewer than LEAST trigrams, or whose best label is not sure enough, is ``unknown``; ties go to the first language by
name; an unknown language counts for no model; letters outside the ranges are of script ``Other``; texts without letters have none; a
repeated row is a document of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import rate, result
from ..sources.scratch import settled
from .families import Family

BUCKETS, FIRST, SECOND = 4093, 1021, 31
PIECE, LEAST, SURE, SECOND_SHARE = 300, 5, 0.6, 0.2
#: Languages a model may have.
MOST = 256
UNKNOWN = "unknown"

# First and last code point of the letters of each script.
SCRIPTS = (
    (0x41, 0x5A, "Latin"), (0x61, 0x7A, "Latin"), (0xAA, 0xAA, "Latin"), (0xBA, 0xBA, "Latin"), (0xC0, 0xD6, "Latin"), (0xD8, 0xF6, "Latin"), (0xF8, 0x24F, "Latin"),
    (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x531, 0x58F, "Armenian"), (0x5D0, 0x5F4, "Hebrew"), (0x620, 0x6FF, "Arabic"),
    (0x900, 0x97F, "Devanagari"), (0x980, 0x9FF, "Bengali"), (0xE01, 0xE5B, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3041, 0x309F, "Hiragana"), (0x30A1, 0x30FF, "Katakana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7A3, "Hangul"),
)


def letters(text: Column) -> Column:
    """Lower-cased, everything but letters as one space, a space around all."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def cells(told: str) -> Iterator[np.ndarray]:
    """The cells of a text's trigrams, given its letters(), in order; each array but the last one is a whole number of pieces."""
    step = PIECE * 4096
    for at in range(0, max(len(told) - 2, 0), step):
        codes = np.frombuffer(told[at : at + step + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        yield (codes[:-2] * FIRST + codes[1:-1] * SECOND + codes[2:]) % BUCKETS


@dataclass(frozen=True)
class Model:
    """Languages in order of their names, and for each the thousandfold logarithm of each cell's probability."""

    languages: tuple[str, ...]
    table: tuple[tuple[int, ...], ...] = field(repr=False)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """A model of all documents with a language. What comes to the driver is a count for each language and cell."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    counts = settled(rows.mapInArrow(_counted, "lang string, cell int, c long").groupBy("lang", "cell").agg(F.sum("c").alias("c")))
    names = sorted(r["lang"] for r in docs.select(lang).distinct().where(F.col(lang).isNotNull()).limit(MOST + 1).toDF("lang").collect())
    if len(names) > MOST:
        raise ValueError(f"a model has at most {MOST} languages")
    total = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    told = counts.join(F.broadcast(total), "lang").select("lang", "cell", _weight(F.col("c"), F.col("n")).alias("w")).unionByName(total.select("lang", F.lit(-1).alias("cell"), _weight(F.lit(0), F.col("n")).alias("w")))
    rows: dict[str, dict[int, int]] = {n: {} for n in names}
    for r in told.collect():  # len(names) * (BUCKETS + 1) rows at most
        rows[r["lang"]][r["cell"]] = r["w"]
    names = [n for n in names if rows[n]]
    return Model(tuple(names), tuple(tuple(rows[n].get(b, rows[n][-1]) for b in range(BUCKETS)) for n in names))


def _weight(c: Column, n: Column) -> Column:
    return F.round(F.log((c + 1.0) / (n + float(BUCKETS))) * 1000).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, np.ndarray] = {}
        for lang, told in zip(batch["lang"].to_pylist(), batch["t"].to_pylist()):
            sums = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for part in cells(told):
                sums += np.bincount(part, minlength=BUCKETS)
        for lang, sums in found.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["lang", "cell", "c"])


def _judged(model: Model):
    names, table = model.languages, np.array(model.table, np.int64).reshape(len(model.languages), BUCKETS)

    def one(told: str) -> tuple:
        scores, shares, n = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), 0
        for part in cells(told):
            if names:
                pieces = np.add.reduceat(table[:, part], np.arange(0, len(part), PIECE), axis=1)
                scores += pieces.sum(axis=1)
                sizes = np.diff(np.append(np.arange(0, len(part), PIECE), len(part)))
                shares += np.bincount(pieces.argmax(axis=0), sizes, len(names)).astype(np.int64)
            n += len(part)
        if not n or not names:
            return UNKNOWN, 0.0, None, 0.0, n
        best = int(scores.argmax())
        sure = round(float(1 / np.exp((scores - scores[best]) / 1000.0 / np.sqrt(n)).sum()), 6)
        shares[best] = 0
        other = int(shares.argmax())
        second = (names[other], round(int(shares[other]) / n, 6)) if shares[other] else (None, 0.0)
        return names[best] if n >= LEAST and sure >= SURE else UNKNOWN, sure, *second, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(one, batch["t"].to_pylist()))) or [()] * 5
            kinds = (pa.string(), pa.float64(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, k) for c, k in zip(found, kinds)]], names=["doc_id", "label", "confidence", "second", "second_share", "trigrams"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label, confidence, second and second_share, trigrams, for every row.

    confidence is the best label's share of the likelihoods, their logarithms divided by the square root of the trigrams' number (neighbouring
    trigrams are no independent witnesses). second is the language of most trigrams in pieces whose own label is another one. A document is
    judged by itself, a batch of texts at a time: exploded trigrams would be many times the text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), letters(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    kind = T.StructType([rows.schema["doc_id"], *[T.StructField(n, k()) for n, k in (("label", T.StringType), ("confidence", T.DoubleType), ("second", T.StringType), ("second_share", T.DoubleType), ("trigrams", T.LongType))]])
    return rows.mapInArrow(_judged(model), kind)


def is_mixed() -> Column:
    """Whether an identified document has a second language."""
    return F.col("second_share") > SECOND_SHARE


@dataclass(frozen=True)
class Language(Family):
    """The language metrics, by a fitted model. Not registered by itself, as it needs one; documents need distinct doc_hash."""

    name: str = "language"
    version: str = "0.1.0-trigrams"
    model: Model | None = None

    def extend(self, docs: DataFrame) -> DataFrame:
        found = identify(docs.dropDuplicates(["doc_hash"]), self.model, "doc_hash").withColumnRenamed("doc_id", "doc_hash")
        return docs.join(found.select("doc_hash", F.col("label").alias("language"), "confidence", is_mixed().alias("mixed_language")), "doc_hash", "left")

    def report(self, c: dict, spreads: dict, docs: DataFrame) -> list[dict]:
        counts = {r["language"]: r["n"] for r in docs.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
        out = [result("lang.histogram", dict(sorted(counts.items())), self.version), result("lang.mixed_rate", rate(c["mixed_language"], c["n"]), self.version)]
        for x in (*self.model.languages, UNKNOWN):
            out += [result(f"lang.{x}.count", counts.get(x, 0), self.version), result(f"lang.{x}.rate", rate(counts.get(x, 0), c["n"]), self.version)]
        return out

    def counters(self) -> dict[str, Column]:
        return {"mixed_language": F.count_if("mixed_language")}


# --- scripts ------------------------------------------------------------------


def script_of(code: Column, ranges=SCRIPTS) -> Column:
    """The script of a code point by a binary search of the sorted ranges."""
    if not ranges:
        return F.lit("Other")
    mid = len(ranges) // 2
    low, high, name = ranges[mid]
    return F.when(code < low, script_of(code, ranges[:mid])).when(code > high, script_of(code, ranges[mid + 1 :])).otherwise(name)


def _classes() -> dict[str, str]:
    out: dict[str, str] = {}
    for low, high, name in SCRIPTS:
        out[name] = out.get(name, "") + f"\\x{{{low:X}}}-\\x{{{high:X}}}"
    return out


#: A run of one script's letters, or of letters of no script known here.
RUN = "|".join([*(f"[{c}]+" for c in _classes().values()), r"\p{L}"])
#: A place where a letter of one script follows a letter of another.
BREAK = "|".join(f"[{c}](?=[{''.join(x for n, x in _classes().items() if n != name)}])" for name, c in _classes().items())


def script_runs(text: Column) -> Column:
    """The runs of a text in order: script and length."""
    return F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.struct(script_of(F.ascii(r)).alias("script"), F.length(r).alias("length")))


def scripts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, script (of most letters; the first by name of equals; null without letters), share, runs, breaks (changes of script inside words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), script_runs(text).alias("runs"), F.regexp_count(text, F.lit(BREAK)).alias("breaks"))
    names = sorted({n for _, _, n in SCRIPTS} | {"Other"})
    total = lambda name: F.aggregate(F.filter("runs", lambda r: r["script"] == name), F.lit(0), lambda a, r: a + r["length"])
    found = F.array_distinct(F.transform("runs", lambda r: r["script"]))
    # Only texts of several scripts are counted script by script.
    many = F.array(*[F.struct((-total(n)).alias("c"), F.lit(n).alias("script")) for n in names])
    every = F.aggregate("runs", F.lit(0), lambda a, r: a + r["length"])
    one = F.struct((-every).alias("c"), F.get(found, F.lit(0)).alias("script"))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("runs"), F.col("breaks").cast("long").alias("breaks"), every.alias("letters"), F.when(F.size(found) > 1, F.array_min(many)).when(F.size(found) == 1, one).alias("top"))
    return rows.select("doc_id", F.col("top.script").alias("script"), F.round(-F.col("top.c") / F.col("letters"), 6).alias("share"), "runs", "breaks")
