"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target by weight, capped at a multiple of its size (water filling). A
document first receives the whole copies that are certain, floor(target / source size).
The words that remain are sampled with unequal probabilities: a document's inclusion probability grows with its
size to the power SIZE_POWER (by octaves of the size), scaled so that the expected words are those that
remain; classes that reach 1 are certain. The others are ranked by random odds over inclusion odds, and
the head of that ranking whose sizes reach the goal is taken once more. The ranking is never sorted
as a whole: sizes are summed by (source, bin of the rank) twice, and only the one bin in
4**LOG_BINS in which a source's goal is crossed is ordered row by row. A few closing rounds add the
document that brings a source nearest to its goal, so small sources end near their targets too.

Defined cases: a null text has size 0 and takes 0, so take_mix() leaves wordless rows out; null is a source of its own, after all
others; repeated rows are separate documents and may be taken unequally often, ties of the ranking are broken by the
row's hash; very long texts are counted whole; an empty table gives an empty result; columns of the input may have any name. Random
numbers are hashes of id, text and a seed, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, packed, pin, read, sweep, text_of

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SIZE_POWER = 0.5
#: Ranks are whole numbers below RANKS; a bin of either level has LOG_BINS bits of them.
LOG_BINS = 10
RANK_BITS = 44
RANKS = 1 << RANK_BITS
CLOSING_ROUNDS = 3
#: Tables of sources and their size classes up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target: weights by rank, filled up to cap * source_size.

    Sources are few next to documents; they are ordered in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    every = Window.partitionBy(F.lit(0))
    by_level = Window.partitionBy(F.lit(0)).orderBy("full_at", F.col("source").isNull(), "source")
    t = sources.withColumn("w", weight).withColumn("limit", limit).withColumn("full_at", F.col("limit") / F.col("w"))
    t = t.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_w", F.sum("w").over(every))
    t = t.withColumn("limit_to", F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("w_to", F.sum("w").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("level", (F.col("total") - F.coalesce("limit_to", F.lit(0.0))) / (F.col("all_w") - F.coalesce("w_to", F.lit(0.0))))
    # The water level is the first that its own source doesn't cut off.
    t = t.withColumn("final", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"])
    return t.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("final"), F.col("full_at")) * F.col("w")).alias("target"))


def chances(classes: DataFrame, power: float) -> DataFrame:
    """classes (source, octave, s, goal) with lam, the inclusion probability of a document of this class.

    lam is c * 2**(power * octave), at most 1, with the c of each source for which the expected words are its goal.
    Classes are filled from the largest sizes on; those that reach 1 are certain.
    """
    weight = F.pow(F.lit(2.0), F.lit(float(power)) * F.col("octave"))
    order = Window.partitionBy("source").orderBy(F.desc("octave"))
    t = classes.withColumn("w", weight)
    before = F.coalesce(F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("s") * F.col("w")).over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("c", F.when(rest > 0, (F.col("goal") - before) / rest))
    fits = F.max(F.when(F.col("c") * F.col("w") <= 1, F.struct("octave", "c"))).over(Window.partitionBy("source"))
    lam = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(fits["c"] * F.col("w"), F.lit(1.0))))
    return t.withColumn("lam", F.when((F.col("goal") > 0) & (F.col("s") > 0), lam).otherwise(F.lit(0.0))).drop("w", "c")


def _with(rows: DataFrame, table: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """rows left joined with table by null-safe keys; a small table is broadcast."""
    names = {k: f"of_{k}" for k in keys}
    table = table.withColumnsRenamed(names)
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return rows.join(F.broadcast(table) if small else table, on, "left").drop(*names.values())


@dataclass
class Plan:
    """What decides each row by its own columns: classes by (source, octave), cuts by source, extras by (source, rank, key)."""

    classes: DataFrame
    cuts: DataFrame
    extras: DataFrame
    rows: DataFrame
    small: bool
    few: bool


def _columns(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """source, size, octave and key: the random number of a row, equal for repeated rows alone."""
    size = n_words(text_of(text_col))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_of(text_col)))
    octave = F.when(size > 0, F.floor(F.log2(size.cast("double")))).otherwise(-1).cast("int")
    return [F.col(source_col).cast("string").alias("source"), size.alias("size"), octave.alias("octave"), key.alias("key")]


def _ranked(rows: DataFrame, plan_classes: DataFrame, small: bool) -> DataFrame:
    """rows with their class's columns, whether the class is certain, and rank: random odds over inclusion odds, as an integer."""
    rows = _with(rows, plan_classes, ["source", "octave"], small)
    u = (F.shiftright("key", 12).bitwiseAND(F.lit((1 << 51) - 1)) + 0.5) / F.lit(float(1 << 51))
    odds = (u / (1 - u)) / (F.col("lam") / (1 - F.col("lam")))
    rank = F.least(F.floor(odds / (1 + odds) * F.lit(float(RANKS))), F.lit(RANKS - 1)).cast("long")
    drawn = (F.col("lam") > 0) & (F.col("lam") < 1) & (F.col("size") > 0)
    return rows.withColumn("sure", F.col("lam") >= 1).withColumn("rank", F.when(drawn, rank))


def _crossing(rows: DataFrame, bin_: Column) -> DataFrame:
    """source, bin and before: the bin in which the running size passes goal - base, and the size that stands before it."""
    sums = rows.where("rank IS NOT NULL").groupBy("source", bin_.alias("bin")).agg(F.sum("size").alias("s"), F.first("base").alias("base"), F.first("goal").alias("goal"))
    upto = F.col("base") + F.sum("s").over(Window.partitionBy("source").orderBy("bin"))
    passed = sums.withColumn("upto", upto).where("upto > goal").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("s")).alias("before"))).alias("x"))
    return passed.select("source", F.col("x.bin").alias("bin"), F.col("x.before").alias("before"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = 7, power: float = SIZE_POWER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Plan:
    base = docs.select(F.col(id_col).alias("doc_id"), *_columns(id_col, text_col, source_col, seed))
    base = pin(base.withColumn("rid", F.monotonically_increasing_id()))
    sums = pin(base.groupBy("source", "octave").agg(F.sum("size").alias("s")))
    goals = pin(targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, cap))
    small = sums.count() <= BROADCAST_ROWS
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("whole", F.floor(ratio)).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    classes = chances(_with(sums, goals, ["source"], small), power)
    certain = F.sum(F.when(F.col("lam") >= 1, F.col("s")).otherwise(0)).over(Window.partitionBy("source"))
    classes = pin(classes.withColumn("base", certain).select("source", "octave", "source_size", "target", "whole", "goal", "lam", "base"))
    sweep(docs.sparkSession)
    rows = _ranked(base, classes, small)
    first = pin(_crossing(rows, F.shiftright("rank", RANK_BITS - LOG_BINS)))
    inside = _with(rows, first, ["source"], small).where(F.shiftright("rank", RANK_BITS - LOG_BINS) == F.col("bin")).drop("bin", "base").withColumnRenamed("before", "base")
    cuts = pin(_crossing(inside, F.shiftright("rank", RANK_BITS - 2 * LOG_BINS)).withColumnRenamed("bin", "cut"))
    rows = _with(rows, cuts, ["source"], small)
    # What is ordered row by row is one in 4**LOG_BINS of a source's rows.
    running = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "key", "rid").rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.where(F.shiftright("rank", RANK_BITS - 2 * LOG_BINS) == F.col("cut")).withColumn("upto", F.col("before") + running).where("upto <= goal")
    edge = pin(edge.select(F.col("rid").alias("erid")))
    sweep(docs.sparkSession)
    rows = rows.join(edge, F.col("rid") == F.col("erid"), "left")
    below = F.col("cut").isNull() | (F.shiftright("rank", RANK_BITS - 2 * LOG_BINS) < F.col("cut"))
    head = F.col("sure") | (F.col("rank").isNotNull() & (below | F.col("erid").isNotNull()))
    rows = pin(rows.withColumn("head", F.coalesce(head, F.lit(False))).drop("erid", "before", "base", "lam"))
    sweep(docs.sparkSession)
    for _ in range(CLOSING_ROUNDS):
        got = rows.groupBy("source").agg(F.first("goal").alias("goal_"), F.sum(F.when(F.col("head"), F.col("size")).otherwise(0)).alias("got"))
        gaps = pin(got.select("source", (F.col("goal_") - F.col("got")).alias("gap")).where("gap > 0"))
        open_ = _with(rows.where("NOT head AND rank IS NOT NULL"), gaps, ["source"], small).where("gap IS NOT NULL AND size < 2 * gap")
        best = open_.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")), "rank", "key", "rid")).alias("b")).select("source", F.col("b.rid").alias("add"))
        rows = _with(rows, pin(best), ["source"], small).withColumn("head", F.col("head") | F.coalesce(F.col("rid") == F.col("add"), F.lit(False))).drop("add")
    rows = pin(rows)
    extras = rows.where("head AND rank IS NOT NULL AND cut IS NOT NULL").where(F.shiftright("rank", RANK_BITS - 2 * LOG_BINS) >= F.col("cut"))
    extras = pin(extras.groupBy("source", "rank", "key").agg(F.count(F.lit(1)).alias("more")))
    sweep(docs.sparkSession)
    return Plan(classes, cuts.select("source", "cut"), extras, rows, small, extras.count() <= BROADCAST_ROWS)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document."""
    rows = plan_mix(docs, **options).rows
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("head"), 1).otherwise(0)).otherwise(0).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def take_mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with the columns of the input.

    Each row is decided by its own source, size, id and text and by the plan's small tables, so no text is moved; only rows
    of a rank that is partly taken are numbered.
    """
    plan = plan_mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    rows = _ranked(packed(docs, *_columns(id_col, text_col, source_col, seed)), plan.classes, plan.small).where("size > 0")
    rows = _with(_with(rows, plan.cuts, ["source"], plan.small), plan.extras, ["source", "rank", "key"], plan.few)
    in_head = F.col("sure") | (F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.shiftright("rank", RANK_BITS - 2 * LOG_BINS) < F.col("cut"))))
    rows = rows.select("doc", "source", "rank", "key", "more", (F.col("whole") + F.when(in_head, 1).otherwise(0)).alias("copies"))
    number = F.row_number().over(Window.partitionBy("source", "rank", "key").orderBy(F.lit(0)))
    some = rows.where("more IS NOT NULL").withColumn("copies", F.col("copies") + F.when(number <= F.col("more"), 1).otherwise(0))
    out = rows.where("more IS NULL").unionByName(some).where("copies > 0")
    return out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("doc.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
