"""Words of documents: lexical diversity, and the terms that tell parts of the corpus apart.

MTLD: tokens are read once in each direction; a factor ends where the share of types among its tokens falls to THRESHOLD, the rest counts
in part, and the measure is tokens by factors, the mean of both directions. Whether a token is a new type of its factor follows from where
its word stood last, so the fold carries two counts and no set of words. Without a factor the measure is the number of tokens.

Salient terms: the terms of each part that are more frequent there than in the rest, by their log-likelihood ratio. A term must make up at
least one in SUPPORT of its part's words. Terms are first counted in CELLS cells of a hash; cells add up over tasks, at most
SUPPORT of a part's cells reach the bound, and no term in another cell can, so only the words of these cells are then counted exactly,
for all parts. What is ranked is at most SUPPORT terms of a part, so the best are taken in an aggregate and nothing is sorted whole.

Defined cases: a null text has no words; without words MTLD and TTR are null; a null part is a part of its own; ties go to the first
term by code point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.spans import let
from ..sources.scratch import settled

#: The share of types, in hundredths, at which a factor ends.
THRESHOLD = 72
SUPPORT, CELLS, TOP = 2000, 1 << 16, 20
#: Cells that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def low_words(text: Column) -> Column:
    return F.transform(tx.words(F.coalesce(text, F.lit(""))), F.lower)


def _neighbours(words: Column) -> Column:
    """For each word in order: before, the place of the same word's last occurrence (else -1), and after, that of its next, counted from the end."""
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def told(s: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            prev, nxt = F.get(s, k - 1), F.get(s, k + 1)
            before = F.when((k > 0) & (prev["w"] == x["w"]), prev["i"]).otherwise(-1)
            after = F.when(nxt["w"] == x["w"], F.size(s) - 1 - nxt["i"]).otherwise(-1)
            return F.struct(x["i"].alias("i"), before.alias("before"), after.alias("after"))

        return F.array_sort(F.transform(s, one))

    return let(placed, told)


def _factors(places: Column) -> Column:
    """The factors of a sequence, given each token's last place."""

    def step(a: Column, p: Column) -> Column:
        types, n = a["types"] + F.when(p < a["start"], 1).otherwise(0), a["at"] - a["start"] + 1
        done = types * 100 <= n * THRESHOLD
        return F.struct((a["at"] + 1).alias("at"), F.when(done, a["at"] + 1).otherwise(a["start"]).alias("start"), F.when(done, 0).otherwise(types).alias("types"), F.when(done, a["whole"] + 1).otherwise(a["whole"]).alias("whole"))

    start = F.struct(*[F.lit(0).alias(x) for x in ("at", "start", "types", "whole")])

    def rest(a: Column) -> Column:
        n = a["at"] - a["start"]
        part = F.when(n > 0, (1.0 - a["types"] / n) / (1.0 - THRESHOLD / 100)).otherwise(0.0)
        return a["whole"] + part

    return F.aggregate(places, start, step, rest)


def mtld(text: Column) -> Column:
    def both(t: Column) -> Column:
        n = F.size(t).cast("double")
        forth, back = _factors(F.transform(t, lambda x: x["before"])), _factors(F.transform(F.reverse(t), lambda x: x["after"]))
        measure = lambda f: let(f, lambda x: F.when(x > 0, n / x).otherwise(n))
        return F.when(n > 0, tx.round6((measure(forth) + measure(back)) / 2))

    return let(let(low_words(text), _neighbours), both)


def ttr(text: Column) -> Column:
    """The share of types among the words."""
    return let(low_words(text), lambda w: F.when(F.size(w) > 0, tx.round6(F.size(F.array_distinct(w)) / F.size(w))))


def salient_terms(docs: DataFrame, part: str, text_col: str = "text", top: int = TOP, support: int = SUPPORT) -> DataFrame:
    """(part, place, term, here, elsewhere, score): the top terms of each part."""
    words = docs.select(F.col(part).alias("part"), F.explode(low_words(F.col(text_col))).alias("term")).withColumn("cell", F.pmod(F.xxhash64("term"), F.lit(CELLS)).cast("int"))
    cells = settled(words.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("c")))
    sizes = settled(cells.groupBy("part").agg(F.sum("c").alias("size")))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    named = sizes.select(F.col("part").alias("of"), "size")
    full = cells.join(named, same("part", "of")).where(F.col("c") * support >= F.col("size"))
    wanted = settled(full.select("cell").distinct())  # CELLS rows at most
    exact = settled(words.join(F.broadcast(wanted), "cell").groupBy("part", "term").agg(F.count(F.lit(1)).alias("here")))
    strong = exact.join(named, same("part", "of")).where(F.col("here") * support >= F.col("size")).drop("of")
    everywhere = exact.join(strong.select("term").distinct(), "term", "left_semi").groupBy(F.col("term").alias("t")).agg(F.sum("here").alias("every"))
    rows = strong.join(everywhere, F.col("term") == F.col("t")).select("part", "term", "here", (F.col("every") - F.col("here")).alias("elsewhere"), "size", (F.lit(total) - F.col("size")).alias("rest"))
    share = (F.col("here") + F.col("elsewhere")) / F.lit(float(max(total, 1)))
    side = lambda n, of: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (F.col(of) * share))).otherwise(0.0)
    more = F.col("here") * F.col("rest") > F.col("elsewhere") * F.col("size")
    rows = rows.where(more).withColumn("score", F.round(2 * (side("here", "size") + side("elsewhere", "rest")), 4))
    # At most support terms of a part come here.
    best = rows.groupBy("part").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "term", "here", "elsewhere", "score"))), 1, top).alias("best"))
    out = best.select("part", F.posexplode("best").alias("place", "b"))
    return out.select("part", (F.col("place") + 1).cast("long").alias("place"), "b.term", "b.here", "b.elsewhere", "b.score")
