"""N-gram Jaccard self-join by grouped prefixes, as components of linked documents.

A document's set is its distinct five-word shingles. Two documents link when
100 * |x & y| >= 75 * |x | y|; the join is exact up to collisions of 64-bit hashes.

1. A sketch of bounded size tells which shingles may occur in two places. Sets are ordered
   rarest first: shingles that occur once, then by the logarithm of their count, then by
   hash. Linked sets share a shingle of their prefixes, the first n - ceil(0.75 n) + 1. A set
   whose prefix has only unshared shingles links with nothing and leaves here.
2. Equal sets collapse to one; sets with the same prefix and size form one group.
3. Groups meet by the shared shingles of their prefixes; sizes and positions filter
   pairs of groups.
4. Pairs expand to members and are verified on the whole sets.

Only components are wanted, so pairs that are linked already by others need no test: each
group is first tested against the pivot of its shingles (the set in which that shingle is
earliest), each member against its group's first; components are formed; and then, in
further waves, only pairs across components that still share a prefix shingle, members of one
group among them, are tested, first of components' pivots, at last every pair that may link at its first common shingle
(_first_common). So no link between components is lost, while a group of thousands of near copies costs about one
test per copy, and a passage that thousands of unlinked documents share costs none. Hot keys may be split (common.dealt_join).

Defined cases: null or wordless texts have an empty set and link with nothing; a text of
fewer than five words is one shingle; repeated rows are equal sets; an empty table gives
an empty result; a null id never is the smallest id of a component that has others; very long texts are
taken whole; equal ids are separate rows; other columns of the input may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import repeats, wordhash
from .common import arrow_limits, dealt_join, drop_rows, input_parts, pin, read, sweep, text_of
from .graph import cross_waves, star_pairs, tagged
from .memory import tidy

K = 5
PERCENT = 75
#: What orders and filters a posting: its place in the ordered set, the size, and its place among shared shingles.
COLS = ["pos", "n", "q"]
SIGNATURE = "doc_id long, th long, n long, sid long, gid long, f int, p int, items binary"


def _sets(texts: pa.Array, k: int):
    """The shingle hashes of each text, repeats included."""
    h, _, _, firsts, _ = wordhash.words(texts, fold=True)
    win = wordhash.windows(h, k)
    for a, z in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if z - a >= k:
            yield win[a : z - k + 1]
        else:
            yield np.array([wordhash.whole(h[a:z])] if z > a else [], np.uint64)


def _keys(k: int, log_blocks: int):
    def run(batches):
        parts = (s for b in batches for part in wordhash.slices(b, 0) for s in [np.concatenate(list(_sets(part.column(0), k)))])
        yield from repeats.blocks(parts, log_blocks)

    return run


def _id(raw: bytes, *more: int) -> int:
    return int.from_bytes(hashlib.blake2b(raw + b"".join(x.to_bytes(8, "little") for x in more), digest_size=8).digest(), "little", signed=True)


def _signatures(k: int, percent: int, shared):
    def run(batches):
        sketch = shared.value
        for batch in batches:
            for part in wordhash.slices(batch, 2):
                cols = [[] for _ in range(8)]
                sets = [np.unique(s) for s in _sets(part.column(2), k)]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                shared_ = sketch.has(flat)
                rank, at = sketch.rank(flat), 0
                for doc_id, th, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets):
                    n, again, r = len(s), shared_[at : at + len(s)], rank[at : at + len(s)]
                    at += n
                    f, p = int(n - again.sum()), n - -(-percent * n // 100) + 1
                    row = (doc_id, th, n, None, None, None, None, None)
                    if n and f < p:
                        late = s[again][np.argsort(r[again], kind="stable")]
                        items = np.concatenate([s[~again], late])
                        row = (doc_id, th, n, _id(s.tobytes()), _id(items[:p].tobytes(), n), f, p, items.tobytes())
                    for c, v in zip(cols, row):
                        c.append(v)
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in SIGNATURE.split(", ")])

    return run


def _postings(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            raw = [x.as_py() for x in part.column(3)]
            n = [len(x) // 8 for x in raw]
            place = np.concatenate([np.arange(c) for c in n]) if n else np.zeros(0, np.int64)
            rows = pa.array(np.repeat(np.arange(len(raw)), n))
            f = part.column(2).take(rows).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(raw), np.int64)), part.column(0).take(rows), part.column(1).take(rows), pa.array((f + place).astype(np.int32)), pa.array(place.astype(np.int32))],
                names=["tok", "gid", "n", "pos", "q"],
            )


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b, xs, ys = batch.columns
            ok = []
            for x, y in zip(xs, ys):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are similar enough."""
    items = sets.select("sid", "items")
    right = dealt_join(pairs, tagged(items, "b"), "b", "sid_b").select("a", "b", "items_b")
    both = dealt_join(right, tagged(items, "a"), "a", "sid_a").select("a", "b", "items_a", "items_b")
    return both.mapInArrow(tidy(_verify(percent)), "a long, b long")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length and positional filter of two postings of one shingle; q is the place among shared shingles."""
    n = lambda t: F.col(f"n_{t}")
    rest = lambda t: F.col(f"n_{t}") - F.col(f"pos_{t}") - 1
    size = (100 * F.least(n(x), n(y)) >= percent * F.greatest(n(x), n(y)))
    most = F.least(F.col(f"q_{x}"), F.col(f"q_{y}")) + 1 + F.least(rest(x), rest(y))
    return size & ((100 + percent) * most >= percent * (n(x) + n(y)))


def _first_common(own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components that may link, made at their first common shingle.

    Sets that link have a first common shingle, with none in common before it, so at most what stands from it on is common:
    a filter that depends on each side's place and size. A set is open if one of its own size or larger could pass it. The
    smaller set of a pair is open, and the larger is less than twice its size, so keys are (shingle, octave of the size) and
    a shingle that thousands of sets have far behind in their order makes no pair at all. If the shingles just before this one
    are equal, it is not the first common one; that leaves about one row for a pair.
    """
    octave = F.length(F.bin("n")) - 1
    left = F.col("n") - F.col("pos")
    before = F.lag("tok").over(Window.partitionBy("id").orderBy("pos", "tok"))
    own = own.select("tok", "id", "n", "comp", left.alias("left"), before.alias("before"), octave.alias("octave"), ((100 + percent) * left >= 2 * percent * F.col("n")).alias("open"))
    own = pin(own)
    small = own.where("open").withColumn("octave", F.explode(F.array(F.col("octave"), F.col("octave") + 1)))
    x, y = tagged(small, "x"), tagged(own, "y")
    c = F.col
    size = (c("n_x") <= c("n_y")) & (100 * c("n_x") >= percent * c("n_y")) & ((c("n_x") < c("n_y")) | (c("id_x") < c("id_y")))
    place = (100 + percent) * F.least("left_x", "left_y") >= percent * (c("n_x") + c("n_y"))
    first = c("before_x").isNull() | c("before_y").isNull() | (c("before_x") != c("before_y"))
    on = (c("tok_x") == c("tok_y")) & (c("octave_x") == c("octave_y"))
    return x.join(y, on & (c("comp_x") != c("comp_y")) & size & place & first).select(c("id_x").alias("a"), c("id_y").alias("b"))


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id, and a hash of the text because ids may be null or clash."""
    return [F.col(id_col).cast("long"), F.xxhash64(text_of(text_col))]


def _linked(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, sets): doc_id, th, n, sid of every row; for each set id s the first (none, id, th) of its component, rows without an id last."""
    spark, parts = docs.sparkSession, input_parts(docs)
    arrow_limits(spark)
    doc_id, th = _row_key(id_col, text_col)
    rows = docs.select(doc_id.alias("doc_id"), th.alias("th"), text_of(text_col).alias("text"))
    log_blocks = repeats.shape_for(parts)
    found = repeats.collect(rows.select("text").mapInArrow(tidy(_keys(k, log_blocks)), repeats.BLOCK), log_blocks, repeats.expected(rows))
    shared = spark.sparkContext.broadcast(found)
    signed = pin(rows.mapInArrow(tidy(_signatures(k, percent, shared)), SIGNATURE))
    shared.destroy()  # the checkpoint needs it no more
    del found
    sets = signed.where("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "th")).alias("did"), *[F.first(c).alias(c) for c in ("n", "gid", "f", "p", "items")])
    sets = pin(sets)
    sweep(spark)
    head = F.expr("substring(items, 8 * f + 1, 8 * (p - f))")
    groups = pin(sets.groupBy("gid").agg(F.min("sid").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n"), F.first("f").alias("f"), F.first(head).alias("head")))
    posts = groups.select("gid", "n", "f", "head").mapInArrow(tidy(_postings), "tok long, gid long, n long, pos int, q int")
    may_link = lambda x, y: _may_link(x, y, percent)
    check = lambda pairs: verified(pairs, sets, percent)
    # First wave: each group with the pivot it shares most shingles with, each member with its group's first.
    toks, pairs = star_pairs(posts.withColumnRenamed("gid", "id"), COLS, may_link)
    # Two members of a group may link with each other and not with its first: the first shingle of the prefix they share keeps them in the waves.
    crowded = groups.where("members > 2").select("gid", "n", "f", F.substring("head", 1, 8).alias("head"))
    crowded = crowded.mapInArrow(tidy(_postings), "tok long, gid long, n long, pos int, q int").select(F.col("tok").alias("k"))
    toks = toks.union(crowded).distinct()
    reps = groups.select(F.col("gid").alias("rg"), "rep")
    pairs = pairs.join(tagged(reps, "x"), F.col("a") == F.col("rg_x")).join(tagged(reps, "v"), F.col("b") == F.col("rg_v")).select(F.col("rep_x").alias("a"), F.col("rep_v").alias("b"))
    inner = dealt_join(sets.select("sid", "gid"), reps, "gid", "rg").where("sid <> rep").select(F.col("sid").alias("a"), F.col("rep").alias("b"))
    sweep(spark)  # the pivots are pinned
    edges = pin(check(pairs.union(inner)))
    sweep(spark)
    # Further waves: groups expand to their members where a shingle still joins different components.
    live = dealt_join(posts, toks, "tok", "k").select("tok", F.col("gid").alias("pg"), *COLS)
    live = dealt_join(sets.select(F.col("sid").alias("id"), "gid"), live, "gid", "pg").select("tok", "id", *COLS)
    comps = cross_waves(live, COLS, may_link, check, edges, lambda own, _: _first_common(own, percent))
    least = sets.select(F.col("sid").alias("s"), "did").join(comps, F.col("s") == F.col("node"), "left").select("s", "did", F.coalesce("comp", "s").alias("c"))
    least = pin(least)
    sweep(spark)
    smallest = least.groupBy(F.col("c").alias("cc")).agg(F.min("did").alias("least"))
    return signed, pin(dealt_join(least, smallest, "c", "cc").select("s", "least"))


def _named(signed: DataFrame, named: DataFrame) -> DataFrame:
    """signed's rows that have a set, with least, the first of their component."""
    return dealt_join(signed.where("sid IS NOT NULL"), named, "sid", "s")


def near_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) for every document."""
    signed, named = _linked(docs, **options)
    met = _named(signed, named).select("doc_id", F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"))
    alone = signed.where("sid IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return alone.unionByName(met)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with the columns of the input: that of the smallest id, then of the smallest text hash.

    Rows are told apart by id and text hash, so null and clashing ids are no harm; of repeated rows one stays.
    """
    signed, named = _linked(docs, **options)
    sweep(docs.sparkSession)
    rows = _named(signed, named).groupBy("doc_id", "th", "sid").agg(F.count(F.lit(1)).alias("c"), F.first("least").alias("least"))
    rows = rows.withColumn("first", F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("th") == F.col("least.th")))
    gone = rows.where("NOT first OR c > 1").select(F.col("doc_id").alias("k0"), F.col("th").alias("k1"), F.col("first").alias("once"))
    return drop_rows(docs, _row_key(options.get("id_col", "doc_id"), options.get("text_col", "text")), gone)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(read(spark, sf_dir, "documents"))


#: Links by counting common shingles, components by reaching along links.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.rid JOIN n y ON b = y.rid WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT x.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(y.doc_id) AS component_id
FROM r JOIN d x ON x.rid = r.a JOIN d y ON y.rid = r.b LEFT JOIN n ON n.rid = r.a GROUP BY x.rid, x.doc_id
"""
