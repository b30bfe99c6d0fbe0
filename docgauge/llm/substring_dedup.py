"""Substring dedup over a De Bruijn graph of token k-mers, compacted to its nonbranching paths.

A window of K words is an edge from its first K - 1 words to its last. An edge that occurs
twice anywhere is repeated, and all words it covers go. Steps:

1. Of the PLACES stretches of K - PLACES + 1 words in a window, that with the smallest hash is its anchor. Equal windows have
   equal anchors at different places, and windows side by side mostly share one, so anchors are a quarter as many. A sketch of
   bounded size tells which anchors may occur twice (it never misses one), and so which edges may repeat. Each
   document's maximal runs of such edges are its walks.
2. Walks are cut where the minimizer (the smallest hash of MINIMIZER words inside the window)
   changes, only so that equal stretches of long walks become equal rows: pieces, kept with their
   source coordinates. Thousands of copies of a passage become one piece with a count.
3. The edges of distinct pieces are counted by an aggregate on both their nodes; those that occur
   once are dropped. An aggregate by node then gives in- and out-degree.
4. Pieces are cut at each node where the graph branches or ends or where some walk begins or ends. What
   is left between two cuts are segments: disjoint, and told by their first edge.
5. A node where one segment ends and one begins joins these two. Segments so linked are one path, found by the
   doubling joins of `graph.chains`, and have its id.
6. A join hands segments back to the source coordinates of their pieces; neighbours on one path are one long span.
   Documents with a span meet the text (a bitmap of fixed size spares the others the shuffle), and the words
   of the spans are removed there.

A node is the 64-bit hash of its K - 1 words, so an edge is compared by 128 bits; pieces by 64.

Defined cases: a null text has no words; a text of less than K words loses none; repeated
rows count as occurrences like any other; windows are judged on the input, never on what is
left; an empty table gives an empty result. A passage that repeats itself is a cycle, which is a path like any other.
Very long texts are hashed in chunks, and a piece has at most LONGEST_PIECE edges. Only id and text columns are read, so
other columns clash with nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, wordhash
from .common import SPACE, arrow_limits, dealt_join, input_parts, marked, n_words, pin, read, sketch, sweep, text_of
from .graph import chains
from .memory import tidy

K = 35
MINIMIZER = 8
LONGEST_PIECE = 64
#: A window's anchor is one of so many stretches. More make fewer anchors, and let through more windows at the ends of a copied passage.
PLACES = 8
#: Bits of the sketch at most: 64 MiB. Anchors that occur twice number about a 70th of the words, so it holds those of 30 GB.
MOST_BITS = 1 << 29
#: The sketch is sized for one in so many of the words.
WORDS_PER_ANCHOR = 8
PIECE = "doc_id long, th long, start int, piece long, nodes binary, begins boolean, ends boolean"
EDGE = "src long, dst long, n long, piece long, at int, begins boolean, ends boolean"
SEGMENT = "piece long, at int, edges int, src long, second long, dst long"
SPAN = "array<struct<start: int, edges: int, path: long>>"


def _places(texts: pa.Array, k: int):
    """(start of each window that lies in one text, its text, firsts, word hashes)."""
    h, _, _, firsts, _ = wordhash.words(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(firsts))
    starts = np.arange(max(0, len(h) - k + 1))
    at = starts[starts + k <= firsts[of[: len(starts)] + 1]]
    return at, of[at], firsts, h


def _anchors(h: np.ndarray, at: np.ndarray, k: int):
    """(hashes of the anchors of the windows at, each place once; for each window, which of them is its)."""
    if not len(at):
        return np.zeros(0, np.uint64), at
    places = min(PLACES, k)
    x = wordhash.windows(h, k - places + 1)
    place = _sliding_argmin(x, places)[at]
    new = np.append(True, place[1:] != place[:-1])  # places never go back, and texts share none
    return wordhash.mix(x[place[new]]), np.cumsum(new) - 1  # mixed again: the smallest of several hashes is a small one


def _keys(k: int, log_blocks: int):
    def run(batches):
        def parts():
            for batch in batches:
                for part in wordhash.slices(batch, 0):
                    at, _, _, h = _places(part.column(0), k)
                    yield _anchors(h, at, k)[0]

        yield from repeats.blocks(parts(), log_blocks)

    return run


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Where the first smallest value of x[i:i + width] stands, for each i with width values left."""
    best, step = np.arange(len(x)), 1
    first = lambda a, b: np.where(x[b] < x[a], b, a)
    while 2 * step <= width:
        best = first(best[: len(best) - step], best[step:])
        step *= 2
    n = len(x) - width + 1
    return first(best[:n], best[width - step : width - step + n]) if step < width else best


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of x[i:i + width] for each i with width values left."""
    n, step = len(x), 1
    while 2 * step <= width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    return np.minimum(x[: n - width + 1], x[width - step : width - step + n - width + 1])


def _pieces(k: int, m: int, shared):
    def run(batches):
        sketch_ = shared.value
        for batch in batches:
            for part in wordhash.slices(batch, 2):
                at, doc, firsts, h = _places(part.column(2), k)
                anchors, mine = _anchors(h, at, k)
                again = sketch_.has(anchors)[mine]
                at, doc = at[again], doc[again]
                if not len(at):
                    continue
                small = _sliding_min(wordhash.windows(h, m), k - m + 1)[at]
                new = np.append(True, (np.diff(at) != 1) | (small[1:] != small[:-1]) | (doc[1:] != doc[:-1]))
                first = np.flatnonzero(new)
                inner = np.arange(len(at)) - first[np.cumsum(new) - 1]
                long = inner % LONGEST_PIECE == 0
                first = np.flatnonzero(new | long)
                end = np.append(first[1:], len(at))
                apart = np.append(True, (np.diff(at) != 1) | (doc[1:] != doc[:-1])) | (long & (inner > 0))
                begins, ends = apart[first], np.append(apart[first[1:]], True)
                lo, hi = at[first], at[end - 1] + k  # the words the piece spans
                piece = wordhash.spans(h, lo, hi)
                d = doc[first]
                nodes = wordhash.windows(h, k - 1).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(d)), part.column(1).take(pa.array(d)), pa.array((lo - firsts[d]).astype(np.int32)),
                        pa.array(piece.view(np.int64)), pa.array([nodes[8 * a : 8 * (z - k + 2)] for a, z in zip(lo.tolist(), hi.tolist())], pa.binary()),
                        pa.array(begins), pa.array(ends),
                    ],
                    names=_names(PIECE),
                )

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _nodes(column: pa.Array):
    """(all nodes of a column of pieces, row of each, place in its piece, nodes of each piece)."""
    raw = column.to_pylist()
    n = np.array([len(x) // 8 for x in raw], np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return np.frombuffer(b"".join(raw), np.int64), of, np.arange(len(of)) - (np.cumsum(n) - n)[of], n


def _piece_edges(batches):
    """Each edge of each piece (piece, n, nodes, begins, ends)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, of, at, n = _nodes(batch.column(2))
        src = np.flatnonzero(at < n[of] - 1)
        row, place = of[src], at[src]
        piece, count, begins, ends = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1, 3, 4))
        cols = (nodes[src], nodes[src + 1], count, piece, place.astype(np.int32), begins & (place == 0), ends & (place == n[row] - 2))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_names(EDGE))


def _inner_nodes(batches):
    """(piece, at, node) of the nodes between two edges of a piece (piece, nodes)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, of, at, n = _nodes(batch.column(1))
        inner = np.flatnonzero((at > 0) & (at < n[of] - 1))
        cols = (batch.column(0).to_numpy()[of[inner]], at[inner].astype(np.int32), nodes[inner])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["piece", "at", "node"])


def _segments(batches):
    """Segments of pieces (piece, nodes, cuts): 2 p stands for a cut at node p, 2 e + 1 for an edge e that occurs once."""
    for batch in batches:
        out = [[] for _ in range(6)]
        for piece, raw, cuts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            nodes = np.frombuffer(raw, np.int64)
            cuts = cuts or ()
            once = {c >> 1 for c in cuts if c & 1}
            at = sorted({0, len(nodes) - 1, *(c >> 1 for c in cuts if not c & 1), *once, *(e + 1 for e in once)})
            for a, z in zip(at, at[1:]):
                if a not in once:
                    for c, v in zip(out, (piece, a, z - a, nodes[a], nodes[a + 1], nodes[z])):
                        c.append(v)
        kinds = (np.int64, np.int32, np.int32, np.int64, np.int64, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, t)) for c, t in zip(out, kinds)], names=_names(SEGMENT))


def _long_spans(batches):
    """Segments of a document that follow each other on one path as one span."""
    for batch in batches:
        rows = []
        for found in batch.column(2).to_pylist():
            spans = []
            for x in sorted(found, key=lambda x: x["start"]):
                if spans and spans[-1]["path"] == x["path"] and spans[-1]["start"] + spans[-1]["edges"] == x["start"]:
                    spans[-1]["edges"] += x["edges"]
                else:
                    spans.append(x)
            rows.append(spans)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("edges", pa.int32()), ("path", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], names=["doc_id", "th", "found"])


def _remove(k: int):
    def run(batches):
        for batch in batches:
            for part in wordhash.slices(batch, 1):
                _, starts, ends, firsts, data = wordhash.words(part.column(1))
                raw, cols = data.tobytes(), [[], [], [], []]
                for i, (doc_id, found) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    a, z = firsts[i], firsts[i + 1]
                    cover = np.zeros(z - a + 1, np.int64)
                    for x in found or ():
                        cover[x["start"]] += 1
                        cover[x["start"] + x["edges"] + k - 1] -= 1
                    left = np.flatnonzero(np.cumsum(cover)[:-1] == 0) + a
                    kept = b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist())])
                    for c, v in zip(cols, (doc_id, z - a, z - a - len(left), kept)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def compact_paths(pieces: DataFrame) -> DataFrame:
    """Segments of the compacted graph where they stand in pieces: piece, at, edges, path.

    pieces (piece, n, nodes, begins, ends) are distinct and pinned. A path is a maximal chain of repeated edges without a branch.
    """
    spark = pieces.sparkSession
    edges = pieces.select("piece", "n", "nodes", "begins", "ends").mapInArrow(tidy(_piece_edges), EDGE)
    # an edge of one occurrence stands in one piece, so the smallest place is its place
    edges = pin(edges.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.min("piece").alias("piece"), F.min("at").alias("at"), F.max("begins").alias("begins"), F.max("ends").alias("ends")))
    sweep(spark)
    solid, one = F.col("n") > 1, (F.col("n") > 1).cast("int")
    sides = edges.select(F.col("src").alias("node"), one.alias("o"), F.lit(0).alias("i"), (F.col("begins") | ~solid).alias("cut"))
    sides = sides.union(edges.select("dst", F.lit(0), one, F.col("ends") | ~solid))
    stops = pin(sides.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("cut").alias("cut")).where("cut OR o <> 1 OR i <> 1").select(F.col("node").alias("stop")))
    sides = None
    sweep(spark)
    inner = pieces.select("piece", "nodes").mapInArrow(tidy(_inner_nodes), "piece long, at int, node long")
    inner = marked(inner, F.col("node"), sketch(stops, F.col("stop")), "maybe").where("maybe")
    cuts = dealt_join(inner, stops, "node", "stop").select("piece", (F.col("at") * 2).alias("c"))
    cuts = cuts.union(edges.where(~solid).select("piece", F.col("at") * 2 + 1))
    cuts = pin(cuts.groupBy(F.col("piece").alias("p")).agg(F.collect_set("c").alias("cuts")))
    edges = stops = inner = None  # else their files stay: a plan keeps all it reads
    sweep(spark)
    cut = pieces.select("piece", "nodes").join(cuts, F.col("piece") == F.col("p"), "left").select("piece", "nodes", "cuts")
    parts = pin(cut.mapInArrow(tidy(_segments), SEGMENT).withColumn("segment", F.xxhash64("src", "second")))
    pieces = cuts = cut = None
    sweep(spark)
    distinct = pin(parts.groupBy("src", "second").agg(F.first("dst").alias("dst"), F.first("segment").alias("segment")))
    begin = distinct.groupBy(F.col("src").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.first("segment").alias("b")).where("n = 1")
    end = distinct.groupBy(F.col("dst").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.first("segment").alias("a")).where("n = 1")
    paths = chains(begin.join(end, F.col("x") == F.col("y")).select("a", "b"))
    met = parts.join(paths, F.col("segment") == F.col("node"), "left")
    return met.select("piece", "at", "edges", F.coalesce("comp", "segment").alias("path"))


def repeated_spans(docs: DataFrame, k: int = K, minimizer: int = MINIMIZER) -> DataFrame:
    """doc_id, th (hash of the text) and found, an array of (start, edges, path): the windows that begin at the edges words from start on are repeated.

    docs has doc_id, th and text; only documents with a repeated window have a row.
    """
    spark, parts = docs.sparkSession, input_parts(docs)
    arrow_limits(spark)
    log_blocks = repeats.shape_for(parts)
    keys = docs.select("text").mapInArrow(tidy(_keys(k, log_blocks)), repeats.BLOCK)
    expected = repeats.expected(docs, WORDS_PER_ANCHOR * MOST_BITS) // WORDS_PER_ANCHOR
    shared = spark.sparkContext.broadcast(repeats.collect(keys, log_blocks, expected, MOST_BITS))
    del keys
    pieces = pin(docs.select("doc_id", "th", "text").mapInArrow(tidy(_pieces(k, minimizer, shared)), PIECE))
    shared.destroy()  # the checkpoint needs it no more
    sweep(spark)
    groups = pin(pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.first("nodes").alias("nodes"), F.max("begins").alias("begins"), F.max("ends").alias("ends")))
    pieces = pin(pieces.select("doc_id", "th", "start", "piece"))  # the nodes are in groups now
    sweep(spark)
    held, groups = [groups], None
    segments = pin(compact_paths(held.pop()).groupBy(F.col("piece").alias("p")).agg(F.collect_list(F.struct("at", "edges", "path")).alias("segments")))
    sweep(spark)
    spots = dealt_join(pieces, segments, "piece", "p")
    spots = spots.select("doc_id", "th", F.explode(F.expr("transform(segments, s -> struct(start + s.at AS start, s.edges AS edges, s.path AS path))")).alias("s"))
    return spots.groupBy("doc_id", "th").agg(F.collect_set("s").alias("found")).mapInArrow(tidy(_long_spans), f"doc_id long, th long, found {SPAN}")


def remove_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    found = pin(repeated_spans(rows, k))
    sweep(docs.sparkSession)
    key = F.xxhash64("doc_id", "th")
    rows = marked(rows, key, sketch(found, key), "maybe")
    clean = F.trim(F.regexp_replace("text", rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " "))
    alone = rows.where("not maybe").select("doc_id", n_words(F.col("text")).alias("n_words"), F.lit(0).cast("long").alias("n_removed"), clean.alias("kept"))
    spots = found.select(F.col("doc_id").alias("fid"), F.col("th").alias("fth"), "found")
    met = rows.where("maybe").join(spots, F.col("doc_id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left")
    return alone.unionByName(met.select("doc_id", "text", "found").mapInArrow(tidy(_remove(k)), "doc_id long, n_words long, n_removed long, kept string"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT rid, i, array_to_string(words[i : i + 34], ' ') AS win FROM d, unnest(range(1, len(words) - 33)) AS u(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY win) AS n FROM w) WHERE n > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM r),
g AS (SELECT rid, list(j) AS gone, count(*) AS n_removed FROM c GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN gone IS NULL THEN array_to_string(words, ' ')
         ELSE (SELECT string_agg(words[j], ' ' ORDER BY j) FROM unnest(range(1, len(words) + 1)) AS u(j) WHERE NOT list_contains(gone, j)) END, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""
