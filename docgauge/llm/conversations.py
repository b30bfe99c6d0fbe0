"""Repair of conversations: the cheapest edits that give every conversation the turns ``(s?(ua)+)?``.

A row's signature symbol is its role's initial (s, u, a or another) and its first fault: blank, duplicate
(role and text seen earlier), truncated or none. Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3, which blank and
duplicate rows need, Insert of an empty turn 2; a truncated row that stays adds 1. Of equally cheap audits, the edits' initials in
order, the ASCII-least is taken.

Which edits are best depends on the signature alone. The distinct signatures are sorted by range and walked as a prefix trie: a
node's DP layer is grown from its parent's, so a shared prefix is computed once, and answers are emitted where a signature
ends. As sorted signatures visit the trie depth first, only the layers of one path are held. A layer has, for each state of the
grammar at which one may come in (nothing yet, s, u, a), the best cost and audit for each state at its end. Equally
cheap audits of one layer are never prefixes of each other, because they have as many rows and only Insert costs without a row; so the least one
stays the least whatever follows.

Rows are ordered once by range, without their texts, and cut at every SEGMENT-th row; a long conversation has many segments, whose answers
are chained. At last a conversation's answers and rows are streamed in order through a task that keeps no more than its
audit: a SHA-256 is a chain of all its bytes and can't be split.

Defined cases: nulls in role and text are one space here; a null conv_id is a conversation, null turns come first; rows of
the same turn go by a digest of role and text, so copies are neighbours; other roles have no place in the grammar and must be reroled or
deleted; texts of any length are hashed whole; a conversation without rows has zeros, an empty audit and the hash of the empty string;
turns that span more than a long count as the largest; an empty table gives an empty result; further columns, whatever their names, do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import beside, in_order
from .common import arrow_limits, join_counted, pin, read, sql_crc32, sweep
from .memory import tidy

#: log2 of the rows after which a conversation's signature is cut.
SEGMENT = 9
CLASSES, FAULTS = "suax", ("none", "blank", "duplicate", "truncated")
#: Symbols of a signature: FAULTS of the first class, of the second and so on.
SYMBOLS = "ABCDEFGHIJKLMNOP"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a.
NOTHING, S, U, A = range(4)
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\f\r"
MOST = (1 << 63) - 1

Best = tuple[int, str]
States = list[Best | None]


def _least(*found: Best | None) -> Best | None:
    return min((x for x in found if x is not None), default=None)


def _plus(x: Best | None, cost: int, edit: str) -> Best | None:
    return None if x is None else (x[0] + cost, x[1] + edit)


def grown(states: States, symbol: str) -> States:
    """The states after one more row, with what may be inserted before it."""
    kind, fault = divmod(SYMBOLS.index(symbol), len(FAULTS))
    nothing, s, u, a = states
    u = _least(u, _plus(nothing, INSERT, "I"), _plus(s, INSERT, "I"), _plus(a, INSERT, "I"))
    a = _least(a, _plus(u, INSERT, "I"))
    out = [_plus(x, DELETE, "D") for x in (nothing, s, u, a)]
    if FAULTS[fault] in ("blank", "duplicate"):
        return out
    more = TRUNCATED if FAULTS[fault] == "truncated" else 0
    before_user = _least(nothing, s, a)
    out[U] = _least(out[U], _plus(before_user, REROLE + more, "R"))
    out[A] = _least(out[A], _plus(u, REROLE + more, "R"))
    if CLASSES[kind] == "s":
        out[S] = _least(out[S], _plus(nothing, more, "K"))
    elif CLASSES[kind] == "u":
        out[U] = _least(out[U], _plus(before_user, more, "K"))
    elif CLASSES[kind] == "a":
        out[A] = _least(out[A], _plus(u, more, "K"))
    return out


def ended(states: States) -> Best:
    """The best of all whole conversations; what still lacks is inserted."""
    return _least(states[NOTHING], states[A], _plus(states[U], INSERT, "I"), _plus(states[S], 2 * INSERT, "II")) or (0, "")


ROOT = [[(0, "") if state == entry else None for state in range(4)] for entry in range(4)]


class Path:
    """The layers of one path of the trie, from the root to the signature looked at last."""

    def __init__(self) -> None:
        self.signature, self.layers, self.computed = "", [ROOT], 0

    def at(self, signature: str) -> list[States]:
        """The layer at which signature ends; layers of the prefix shared with the last one are not computed again."""
        shared = 0
        for x, y in zip(self.signature, signature):
            if x != y:
                break
            shared += 1
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            self.layers.append([grown(states, symbol) for states in self.layers[-1]])
            self.computed += 1
        self.signature = signature
        return self.layers[-1]


def written(layer: list[States]) -> str:
    """A layer as text: entry, end, cost and audit of each."""
    return ",".join(f"{entry}{end}{best[0]}:{best[1]}" for entry, states in enumerate(layer) for end, best in enumerate(states) if best is not None)


def answers(signatures: DataFrame) -> DataFrame:
    """(sig, n, layer) for a pinned table of distinct signatures (sig, n)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = Path()
        for batch in batches:
            layers = [written(path.at(x)) for x in batch["sig"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["sig"], batch["n"], pa.array(layers, pa.string())], names=["sig", "n", "layer"])

    return signatures.repartitionByRange("sig").sortWithinPartitions("sig").mapInArrow(tidy(walk), "sig string, n long, layer string")


def _bare(text: Column) -> Column:
    """The text up to its last character that is no blank."""
    return F.rtrim(text, F.lit(BLANKS))


def _prepared(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, mark): no nulls in role and text; mark tells conversation, role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    told = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.unhex(F.sha2(told.cast("binary"), 256)).alias("mark"))


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, block, sig) pinned, for _prepared() rows; a conversation's blocks are in order."""
    bare, initial = _bare(F.col("text")), F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    small = rows.select(
        "conv_id", "turn", "mark", kind.alias("kind"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    placed = in_order(small, ["conv_id", "turn", "mark"])
    repeats = placed.where("NOT blank").groupBy("mark").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    marked = beside(placed, pin(repeats.select("mark", "first")), ["mark"], "left")
    fault = F.when(F.col("blank"), 1).when(F.col("mid") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    symbol = F.substring(F.lit(SYMBOLS), F.col("kind") * len(FAULTS) + fault + 1, F.lit(1))
    cells = F.array_sort(F.collect_list(F.struct("mid", symbol.alias("symbol"))))
    runs = marked.groupBy("conv_id", F.shiftright("mid", SEGMENT).alias("block")).agg(cells.alias("cells"))
    return pin(runs.select("conv_id", "block", F.array_join(F.transform("cells", lambda x: x["symbol"]), "").alias("sig")))


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """One conversation of the stream: first its segments in order, then its rows in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.counts, self.illegal, self.last = conv_id, [0] * len(FAULTS), 0, ""
        self.sure: list[str] = []  # what all audits that are still open begin with
        self.states: States = list(ROOT[NOTHING])
        self.audit, self.cost = None, 0
        self.turns, self.low, self.high = 0, None, None
        self.hash, self.lines, self.state, self.at = hashlib.sha256(), 0, NOTHING, 0

    def segment(self, sig: str, layer: str) -> None:
        for symbol in sig:
            kind, fault = divmod(SYMBOLS.index(symbol), len(FAULTS))
            self.counts[fault] += 1
            self.illegal += bool(self.last) and self.last + CLASSES[kind] not in LEGAL
            self.last = CLASSES[kind]
        new: States = [None] * 4
        for x in layer.split(","):
            (cost, audit), entry, end = x[2:].split(":"), int(x[0]), int(x[1])
            new[end] = _least(new[end], _plus(self.states[entry], int(cost), audit))
        open_ = [x[1] for x in new if x is not None]
        low, high, k = min(open_), max(open_), 0
        while k < len(low) and k < len(high) and low[k] == high[k]:
            k += 1
        self.sure.append(low[:k])
        self.states = [None if x is None else (x[0], x[1][k:]) for x in new]

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode())
        self.hash.update(f"{role}:{text}".encode())
        self.lines += 1

    def _next(self) -> str:
        self.state = A if self.state == U else U
        return "assistant" if self.state == A else "user"

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(self._next(), "")
            self.at += 1

    def close_segments(self) -> None:
        if self.audit is None:
            self.cost, rest = ended(self.states)
            self.audit, self.sure = "".join([*self.sure, rest]), []

    def row(self, turn: int | None, role: str, text: str) -> None:
        self.close_segments()
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._line(self._next(), text)
        elif edit == "K":
            self._line(role, text)
            self.state = {"s": S, "u": U, "a": A}[role[0]]

    def result(self) -> tuple:
        self.close_segments()
        self._inserts()
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)
        return self.conv_id, gaps, *self.counts[1:], self.illegal, self.cost, self.audit, self.hash.hexdigest()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    for batch in batches:
        for conv_id, kind, at, role, text, sig, layer in zip(*(batch[c].to_pylist() for c in ("conv_id", "kind", "at", "role", "text", "sig", "layer"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(conv_id)
            if kind == 1:
                now.segment(sig, layer)
            elif kind == 2:
                now.row(at, role, text)
        if len(out) >= 1000:
            yield flush()
            out = []
    if now is not None:
        out.append(now.result())
    if out:
        yield flush()


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """RESULT for conversations (conv_id, turn, role, text). ids may name further conv_ids, which may have no rows."""
    arrow_limits(rows.sparkSession)
    rows = _prepared(rows)
    parts = segments(rows)
    found = pin(answers(pin(parts.groupBy("sig").agg(F.count(F.lit(1)).alias("n")))))
    sweep(rows.sparkSession)
    solved = join_counted(parts, found.select(F.col("sig").alias("s"), "n", "layer"), "sig", "s", "n")
    none = lambda kind: F.lit(None).cast(kind)
    heads = solved.select("conv_id", F.lit(1).alias("kind"), F.col("block").alias("at"), none("binary").alias("mark"), none("string").alias("role"), none("string").alias("text"), "sig", "layer")
    lines = rows.select("conv_id", F.lit(2).alias("kind"), F.col("turn").alias("at"), "mark", "role", "text", none("string").alias("sig"), none("string").alias("layer"))
    stream = heads.unionByName(lines)
    if ids is not None:
        stream = stream.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(0).alias("kind")), allowMissingColumns=True)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "at", "mark")]
    return stream.repartition("conv_id").sortWithinPartitions(*order).drop("mark").mapInArrow(tidy(_streamed), RESULT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with n, how often each is given: 0 to drop it, 2 to repeat it; some lose their text, their stops or their role."""
    told = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    code = F.crc32(told.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("n"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read(spark, sf_dir, "conversations"))
    kept = rows.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    return repair(kept, rows.where("n = 0").select("conv_id"))


def _sql() -> str:
    blanks = "||".join(f"chr({ord(c)})" for c in BLANKS)

    def plus(x: str, cost: str, edit: str, line: str = "''", when: str = "true") -> str:
        return f"CASE WHEN {x} IS NOT NULL AND {when} THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 't': {x}.t || {line}}} END"

    insert = lambda x, role: plus(x, "2", "I", f"'{role}:' || chr(10)")
    line = lambda role: f"{role} || ':' || r.text || chr(10)"
    stays = "r.fault IN ('none', 'truncated')"
    keep = lambda x, kind: plus(x, "r.more", "K", line("r.role"), f"{stays} AND r.kind = '{kind}'")
    rerole = lambda x, role: plus(x, "(2 + r.more)", "R", line(f"'{role}'"), stays)
    delete = lambda x: plus(x, "3", "D")
    nothing = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    count = lambda f: f"count(*) FILTER (fault = '{f}') AS {f}"
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS code FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM c WHERE code <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(coalesce(conv_id::VARCHAR, '-'), ':', strlen(role), ':', role, text)), copy) AS i,
         rtrim(text, {blanks}) AS bare FROM d),
f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         left(role, 1) AS kind, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
r AS (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS more FROM f),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {count("blank")}, {count("duplicate")}, {count("truncated")},
         count(*) FILTER (prev IS NOT NULL AND prev || kind NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
-- The best way to each state of the grammar after i rows: nothing yet, after s, after u, after a.
p(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), {nothing}, {nothing}, {nothing} FROM s
  UNION ALL
  SELECT p.conv_id, p.i + 1, {delete("s0")}, least({delete("s1")}, {keep("s0", "s")}),
    least({delete("q.u")}, {", ".join(f"{keep(x, 'u')}, {rerole(x, 'user')}" for x in ("s0", "s1", "q2.a"))}),
    least({delete("q2.a")}, {keep("q.u", "a")}, {rerole("q.u", "assistant")})
  FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1,
  LATERAL (SELECT least(s2, {", ".join(insert(x, "user") for x in ("s0", "s1", "s3"))}) AS u) q,
  LATERAL (SELECT least(s3, {insert("q.u", "assistant")}) AS a) q2),
e AS (
  SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal,
         least(s0, s3, {insert("s2", "assistant")}, {plus("s1", "4", "II", "'user:' || chr(10) || 'assistant:' || chr(10)")}) AS best
  FROM s JOIN p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.i = s.n)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, length(best.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""


OP11_SQL = _sql()
