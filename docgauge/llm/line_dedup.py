"""Line dedup: a segment-partition edit join of all lines, exact within MAX_EDITS edits.

A line of at least MIN_CHARS characters is split into MAX_EDITS + 1 even segments. If two
lines are within MAX_EDITS edits, some segment of the shorter stands in the longer, not far from
its place; how far depends on the lengths and the segment's number (the multi-match rule), so a line
probes few substrings for each length it can meet. Segments and probes are hashed with
their length and number:

1. A sketch of bounded size tells which of these keys occur twice; only lines with such a key go on.
2. Equal lines collapse to one. Lines that share a key, and whose counts of characters are near, are
   candidates; they are tested by a banded bit-parallel edit distance, a batch of pairs at a time.
3. Linked lines form classes; pairs already in one class are not tested (see graph.py). Lines of a frequent
   segment are at last paired by their rarest grams (_last_pairs), so that a template makes no pairs of all its lines.
4. Shorter lines have no segments. If asked for, they have one key, of the whole line, and equal ones form a class.
5. The first occurrence of a class, by document id and line number, stays; the others go.

Defined cases: a null text has one empty line; empty lines always stay, and so do lines shorter
than MIN_CHARS unless their exact copies are asked for; lines are compared without surrounding white space; the ids of repeated rows count as one document; rows
without an id come last; very long lines and texts are taken whole; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, wordhash
from .common import arrow_limits, dealt_join, input_parts, marked, pin, read, sketch, sweep, text_of, unsent
from .graph import cross_waves, star_pairs, tagged
from .memory import tidy

MAX_EDITS = 2
#: Length of the grams that tell lines of a frequent segment apart, and buckets of their counts.
GRAM, GRAM_BUCKETS = 3, 1 << 16
#: Lines from this length on are joined within MAX_EDITS: the least at which near lines must share a gram.
MIN_CHARS = GRAM * (MAX_EDITS + 1)
OCCURRENCE = "doc_id long, th long, line_no int, lid long, line string, keys binary, roles binary"
#: What orders and filters a posting: its role, the line's length, and how many of its characters fall into 16 bins.
COLS = ["role", "len", "low", "high"]
BINS = 16
#: A random number for each character of the basic plane; the others are mixed one by one.
_CODES = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, 1 << 16, np.uint64)
_chars = wordhash._Powers(0xA0761D6478BD642F | 1)
#: Lines whose text a task has sent already, at most; beyond it texts are sent again.
SEEN = 500_000


def _lines(texts: list[str]):
    """(document, number, line) of the lines that take part."""
    for d, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            yield d, k, line.strip()


def segment(length, number, edits: int):
    """Start and length of a segment, for arrays of line lengths; longer segments come last."""
    short, longer = length // (edits + 1), length % (edits + 1)
    before = number - (edits + 1 - longer)
    return number * short + np.maximum(before, 0), short + (number >= edits + 1 - longer)


def keys_of(lines: list[str], edits: int, least: int, short: bool = False):
    """(line, key, role) arrays: role 0 for a line's own segments, 1 for its probes; and the lines' hashes.

    With short, a line too short for segments has one key, of the whole line.
    """
    size = np.array([len(x) for x in lines], np.int64)
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = _CODES[code & 0xFFFF]
    if len(code) and code.max() > 0xFFFF:
        far = code > 0xFFFF
        chars[far] = wordhash.mix(code[far].astype(np.uint64))
    begin = np.cumsum(size) - size
    up, down = _chars.upto(len(code) + 1)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(chars * up[:-1]))
    part = lambda a, z: (sums[z] - sums[a]) * down[a]
    lid = wordhash.mix(part(begin, begin + size) + size.astype(np.uint64)).view(np.int64)
    at, keys, roles = [], [], []
    every = np.arange(len(lines))
    if short:
        at.append(every[size < least])
        keys.append(wordhash.mix(lid[size < least].view(np.uint64)))
        roles.append(np.zeros(len(at[0]), np.uint8))
    for delta in range(edits + 1):
        length = size - delta
        for i in range(edits + 1):
            p, n = segment(length, i, edits)
            low = max(-i, delta - (edits - i))
            high = min(i, delta + (edits - i))
            for shift in range(low, high + 1):
                own = delta == 0 and shift == 0
                ok = (length >= least) & (p + shift >= 0) & (p + shift + n <= size)
                a = (begin + p + shift)[ok]
                k = wordhash.mix(part(a, a + n[ok]) ^ wordhash.mix((length[ok] * 64 + i).astype(np.uint64)))
                at.append(every[ok])
                keys.append(k)
                roles.append(np.full(len(k), 0 if own else 1, np.uint8))
    return np.concatenate(at), np.concatenate(keys), np.concatenate(roles), lid


def _batches(batch: pa.RecordBatch, column: int, least: int, short: bool):
    for part in wordhash.slices(batch, column, 2 << 20):
        rows = [x for x in _lines(part.column(column).to_pylist()) if len(x[2]) >= (1 if short else least)]
        if rows:
            yield part, rows


def _keys(edits: int, least: int, short: bool, log_blocks: int):
    def run(batches):
        parts = (keys_of([x[2] for x in rows], edits, least, short)[1] for b in batches for _, rows in _batches(b, 0, least, short))
        yield from repeats.blocks(parts, log_blocks)

    return run


def _candidates(edits: int, least: int, short: bool, shared):
    def run(batches):
        found, seen = shared.value, set()
        for batch in batches:
            for part, rows in _batches(batch, 2, least, short):
                at, keys, roles, lid = keys_of([x[2] for x in rows], edits, least, short)
                hit = found.has(keys)
                at, keys, roles = at[hit], keys[hit], roles[hit]
                order = np.argsort(at, kind="stable")
                at, keys, roles = at[order], keys[order], roles[order]
                own, first, n = np.unique(at, return_index=True, return_counts=True)
                ids, ths = part.column(0), part.column(1)
                cols = [[] for _ in range(7)]
                for r, a, c in zip(own.tolist(), first.tolist(), n.tolist()):
                    d, k, line = rows[r]
                    name = int(lid[r])
                    sent = len(line) < least or name in seen  # a short line's hash is all that is compared
                    row = (ids[d].as_py(), ths[d].as_py(), k, name, None if sent else line, None if sent else keys[a : a + c].tobytes(), None if sent else roles[a : a + c].tobytes())
                    if not sent and len(seen) < SEEN:
                        seen.add(name)
                    for col, v in zip(cols, row):
                        col.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in OCCURRENCE.split(", ")])

    return run


def _postings(batches):
    for batch in batches:
        raw = [x.as_py() for x in batch.column(2)]
        n = [len(x) // 8 for x in raw]
        rows = pa.array(np.repeat(np.arange(len(raw)), n))
        roles = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), np.uint8)
        bins = np.ascontiguousarray((_counts(batch.column(4).to_pylist(), BINS) & 255).astype(np.uint8)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.frombuffer(b"".join(raw), np.int64)), batch.column(0).take(rows), pa.array(roles.astype(np.int32)), batch.column(1).take(rows), pa.array(bins[:, 0]).take(rows), pa.array(bins[:, 1]).take(rows)],
            names=["tok", "id", "role", "len", "low", "high"],
        )


def _apart(x: str, y: str) -> Column:
    """How far the character counts of two postings are apart, bin by bin and modulo 256: an edit moves it by two at most."""
    def count(word: str, tag: str, k: int) -> Column:
        return F.shiftright(f"{word}_{tag}", 8 * k).bitwiseAND(F.lit(255).cast("long"))

    out = F.lit(0)
    for word in ("low", "high"):
        for k in range(8):
            d = F.pmod(count(word, x, k) - count(word, y, k), F.lit(256))
            out = out + F.least(d, F.lit(256) - d)
    return out


def within(xs: list[str], ys: list[str], edits: int) -> np.ndarray:
    """Whether each pair is within so many edits: bit-parallel, banded, all pairs of the batch in step.

    The word of a pair holds the vertical differences of the band's cells, its top bit the
    lowest diagonal. The score is followed down that diagonal until the longer line ends, then along the last row.
    """
    if edits > 30:
        raise ValueError("the band must fit into a word")
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(xs, ys)]
    out = np.zeros(len(pairs), bool)
    # An edit changes two of the counts of characters by one at most; this spares most pairs that share a segment by chance.
    apart = np.abs(_counts([x for x, _ in pairs]) - _counts([y for _, y in pairs])).sum(axis=1)
    order = sorted(np.flatnonzero(apart <= 2 * edits).tolist(), key=lambda i: len(pairs[i][0]))
    for k in range(0, len(order), 2048):
        part = [i for i in order[k : k + 2048] if len(pairs[i][0]) - len(pairs[i][1]) <= edits]
        if part:
            out[part] = _within([pairs[i] for i in part], edits)
    return out


def _counts(lines: list[str], bins: int = 32) -> np.ndarray:
    """How many characters of each line fall into each bin."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32) & (bins - 1)
    line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return np.bincount(line * bins + code, minlength=bins * len(lines)).reshape(len(lines), bins)


def _within(pairs, edits: int) -> np.ndarray:
    one, top = np.uint64(1), np.uint64(63)
    la, lb = (np.array([len(p[j]) for p in pairs], np.int64) for j in (0, 1))
    out = np.array([x == y for x, y in pairs])
    wide = int(la.max()) + 2 * edits + 2

    def table(j, shift):
        m = np.full((wide, len(pairs)), 0xFFFFFFFF - j, np.uint32)
        for c, p in enumerate(pairs):
            m[shift : shift + len(p[j]), c] = np.frombuffer(p[j].encode("utf-32-le", "surrogatepass"), np.uint32)
        return m

    a, b = table(0, edits), table(1, 0)  # row i + edits of a has character i
    vp = np.full(len(pairs), ((1 << 64) - 1) << (63 - edits) & ((1 << 64) - 1), np.uint64)
    vn = np.zeros(len(pairs), np.uint64)
    score = np.full(len(pairs), edits, np.int64)
    row = np.full(len(pairs), 62, np.int64)
    for i in range(int(lb.max())):
        x = np.zeros(len(pairs), np.uint64)
        for d in range(2 * edits + 1):  # bit 63 - d is character i + edits - d of the longer line
            x |= (a[i + 2 * edits - d] == b[i]).astype(np.uint64) << np.uint64(63 - d)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        live, down = i < lb, i < la - edits
        score += (live & down & ((d0 >> top) == 0)).astype(np.int64)
        bit = np.maximum(row, 0).astype(np.uint64)
        flat = live & ~down
        score += np.where(flat, ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64), 0)
        row -= flat
        d1 = d0 >> one
        vp = hn | ~(d1 | hp)
        vn = d1 & hp
    return out | (score <= edits)


def _verify(edits: int):
    def run(batches):
        for batch in batches:
            ok = pa.array(within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    text = lines.select("id", "line")
    right = pairs.join(unsent(tagged(text, "b")), F.col("b") == F.col("id_b")).select("a", "b", "line_b")
    both = right.join(unsent(tagged(text, "a")), F.col("a") == F.col("id_a")).select("a", "b", "line_a", "line_b")
    return both.mapInArrow(tidy(_verify(edits)), "a long, b long")


#: Up to so many lines of a segment are paired with each other.
CROWD = 32


def _grams(line: str) -> np.ndarray:
    """The hashes of a line's grams; equal grams differ by how many stand before them, so they form a set."""
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = np.zeros(len(code) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        x = wordhash.mix(x ^ (code[k : len(x) + k] + np.uint64(1)))
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(x[order]) != 0))
    number = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return wordhash.mix(x[order] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _gram_counts(batches):
    total = np.zeros(GRAM_BUCKETS, np.int64)
    for batch in batches:
        for line in batch.column(0).to_pylist():
            np.add.at(total, (_grams(line) & np.uint64(GRAM_BUCKETS - 1)).astype(np.int64), 1)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["bucket", "n"])


def _rare_grams(edits: int, shared):
    def run(batches):
        counts = shared.value
        for batch in batches:
            ids, found = [], []
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _grams(line)
                rare = x[np.lexsort((x, counts[(x & np.uint64(GRAM_BUCKETS - 1)).astype(np.int64)]))[: GRAM * edits + 1]]
                ids += [i] * len(rare)
                found.append(rare.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(found) if found else [], pa.int64())], names=["gid", "gram"])

    return run


def _last_pairs(own: DataFrame, counts: DataFrame, lines: DataFrame, edits: int, may_link) -> DataFrame:
    """Pairs (a, b) across classes that may link, by segment and, where more than CROWD lines have it, by rare grams.

    An edit changes GRAM grams at most. So lines within so many edits, their grams ordered rarest first, share one of
    the first GRAM * edits + 1: lines of one template meet only if the parts in which they differ are alike.
    """
    spark = own.sparkSession
    crowded = counts.where(F.col("n") > CROWD).select(F.col("k").alias("ck"), F.lit(True).alias("crowd"))
    own = pin(own.join(unsent(crowded), F.col("tok") == F.col("ck"), "left").drop("ck"))
    texts = lines.join(unsent(own.where("crowd").select(F.col("id").alias("oid")).distinct()), F.col("id") == F.col("oid"), "left_semi").select("id", "line")
    total = np.zeros(GRAM_BUCKETS, np.int64)
    for r in texts.select("line").mapInArrow(tidy(_gram_counts), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]  # GRAM_BUCKETS rows at most
    shared = spark.sparkContext.broadcast(total)
    rare = texts.mapInArrow(tidy(_rare_grams(edits, shared)), "gid long, gram long")
    fine = own.where("crowd").join(unsent(rare), F.col("id") == F.col("gid")).withColumn("tok", F.xxhash64("tok", "gram")).drop("gid", "gram", "crowd")
    both = own.where("crowd IS NULL").drop("crowd").unionByName(fine)
    meet = tagged(both, "x").join(unsent(tagged(both, "y")), (F.col("tok_x") == F.col("tok_y")) & (F.col("comp_x") < F.col("comp_y")) & may_link("x", "y"))
    return meet.select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))


def repeated_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """(occurrences, classes) for docs (doc_id, th, text).

    occurrences: doc_id, th, line_no, lid of lines that may repeat; classes: node (lid), comp, for lines with a near line.
    """
    if least < GRAM * (edits + 1):
        raise ValueError("lines must be longer for so many edits")
    spark, parts = docs.sparkSession, input_parts(docs)
    arrow_limits(spark)
    log_blocks = repeats.shape_for(parts)
    found = repeats.collect(docs.select("text").mapInArrow(tidy(_keys(edits, least, short, log_blocks)), repeats.BLOCK), log_blocks, repeats.expected(docs))
    shared = spark.sparkContext.broadcast(found)
    spots = pin(docs.select("doc_id", "th", "text").mapInArrow(tidy(_candidates(edits, least, short, shared)), OCCURRENCE))
    shared.destroy()  # the checkpoint needs it no more
    del found
    sweep(spark)
    lines = spots.where("line IS NOT NULL").groupBy(F.col("lid").alias("id")).agg(*[F.first(c).alias(c) for c in ("line", "keys", "roles")])
    lines = pin(lines.withColumn("len", F.char_length("line").cast("long")))
    posts = lines.select("id", "len", "keys", "roles", "line").mapInArrow(tidy(_postings), "tok long, id long, role int, len long, low long, high long")

    def may_link(x: str, y: str) -> Column:
        near = F.abs(F.col(f"len_{x}") - F.col(f"len_{y}")) <= edits
        own = (F.col(f"role_{x}") == 0) | (F.col(f"role_{y}") == 0)
        return near & (F.col(f"id_{x}") != F.col(f"id_{y}")) & own & (_apart(x, y) <= 2 * edits)

    check = lambda pairs: verified(pairs, lines, edits)
    toks, pairs = star_pairs(posts, COLS, may_link, best_only=False)
    edges = pin(check(pairs))
    sweep(spark)
    live = dealt_join(posts, toks, "tok", "k").drop("k")
    # Every pivot has been tried, and candidates are few: one wave over what still joins different classes is enough.
    last = lambda own, counts: _last_pairs(own, counts, lines, edits, may_link)
    return spots.select("doc_id", "th", "line_no", "lid"), cross_waves(live, COLS, may_link, check, edges, last, waves=1)


def _drop(batches):
    for batch in batches:
        cols = [[] for _ in range(4)]
        for doc_id, text, gone in zip(*[c.to_pylist() for c in batch.columns]):
            lines, gone = text.split("\n"), set(gone or ())
            left = [x for k, x in enumerate(lines) if k not in gone]
            for c, v in zip(cols, (doc_id, len(lines), len(lines) - len(left), "\n".join(left))):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_lines", "n_dropped", "kept"])


def drop_repeated_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without the dropped lines) for every document; short: drop exact copies of shorter lines too."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    spots, classes = repeated_lines(rows, edits, least, short)
    classes = pin(classes)
    named = pin(spots.join(unsent(classes), F.col("lid") == F.col("node"), "left").select("doc_id", "th", "line_no", F.coalesce("comp", "lid").alias("class")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line_no")
    first = pin(named.groupBy(F.col("class").alias("c")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    gone = named.join(unsent(first), F.col("class") == F.col("c")).where(~place.eqNullSafe(F.col("first")))
    gone = pin(gone.groupBy(F.col("doc_id").alias("gid"), F.col("th").alias("gth")).agg(F.collect_set("line_no").alias("gone")))
    rows = marked(rows, F.xxhash64("doc_id", "th"), sketch(gone, F.xxhash64("gid", "gth")), "maybe")
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    alone = rows.where("not maybe").select("doc_id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    met = rows.where("maybe").join(unsent(gone), F.col("doc_id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    return alone.unionByName(met.select("doc_id", "text", "gone").mapInArrow(tidy(_drop), "doc_id long, n_lines long, n_dropped long, kept string"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(read(spark, sf_dir, "documents"), short=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
