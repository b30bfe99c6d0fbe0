"""Exact duplicates of a stream: state by hash, timers, and a table of what became known.

A hash has a state from its first document on: when its session was opened, its first document, the latest event time and the number of its
documents. Each batch tells, for every hash it brings, one row of a growing table. A hash without a document for idle milliseconds of event
time is closed by its timer: a closing row is told and its state goes, so a document after that opens another session. Rows later
than the watermark reach no state; Spark counts them (late_rows).

A session's first document is decided by event time and then by id, in whatever batches they come.

Spark hands each group to Python by itself, which takes some milliseconds, so hashes share groups: a bucket's state holds the states of its
hashes, and its timer is that of the hash that runs out first. A hash is told and closed as if it were alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A hash's state after a batch. session is the earliest event time of the batch that opened it; times are in milliseconds.
CHANGE = "doc_hash string, session long, first_at long, first_id long, last_at long, copies long, closed boolean"
COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]
#: A bucket's state, a column for each of CHANGE but the last.
STATE = ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in CHANGE.split(", ")[:-1])
#: Groups that hashes are dealt to.
BUCKETS = 8192
#: Stands for an id or a time that is missing: after all others.
MISSING = (1 << 63) - 1


def _gathered(batches: Iterator[pd.DataFrame]) -> dict[str | None, tuple[int, int, int, int]]:
    """By hash: earliest time and its smallest id, latest time, rows. A hot hash comes in many bounded batches."""
    out: dict[str | None, tuple[int, int, int, int]] = {}
    for rows in batches:
        for h, i, ms in zip(rows["doc_hash"].tolist(), rows["doc_id"].tolist(), rows["ms"].tolist()):
            at, first, last, n = out.get(h, (ms, i, -1 << 63, 0))
            if (ms, i) < (at, first):
                at, first = ms, i
            out[h] = (at, first, max(last, ms) if ms != MISSING else last, n + 1)
    return out


def _advance(idle_ms: int):
    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {h: rest for h, *rest in zip(*state.get)} if state.exists else {}
        now = {} if state.hasTimedOut else _gathered(batches)
        mark, told = state.getCurrentWatermarkMs(), []
        for h, (at, i, last, n) in now.items():
            session = at
            if h in known:
                session, first_at, first_id, before, had = known[h]
                (at, i), last, n = min((at, i), (first_at, first_id)), max(last, before), n + had
            if session == MISSING:
                raise ValueError(f"no document of hash {h} has a time")
            known[h] = [session, at, i, last, n]
            told.append((h, *known[h], False))
        over = [h for h, x in known.items() if h not in now and x[3] + idle_ms < mark]
        told += [(h, *known.pop(h), True) for h in over]
        if known:
            state.update(tuple(map(list, zip(*((h, *x) for h, x in known.items())))))
            state.setTimeoutTimestamp(max(min(x[3] for x in known.values()) + idle_ms, mark + 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=COLUMNS)

    return step


def copies(docs: DataFrame, time_col: str, late: str = "10 minutes", idle_ms: int = 3_600_000, buckets: int = BUCKETS) -> DataFrame:
    """CHANGE rows of a stream with doc_id and doc_hash, to be appended to a table. A stream keeps its number of buckets."""
    whole = lambda c: F.coalesce(c, F.lit(MISSING))
    bucket = F.pmod(F.xxhash64("doc_hash"), F.lit(buckets)).alias("bucket")
    rows = docs.withWatermark(time_col, late).select("doc_hash", whole(F.col("doc_id").cast("long")).alias("doc_id"), time_col, whole(F.unix_millis(time_col)).alias("ms"), bucket)
    told = rows.groupBy("bucket").applyInPandasWithState(_advance(idle_ms), CHANGE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return told.withColumn("first_id", F.nullif("first_id", F.lit(MISSING)))


def current(changes: DataFrame) -> DataFrame:
    """The last row of each session. Copies only grow, and a closing row comes last."""
    own = COLUMNS[2:]
    last = F.max(F.struct("copies", "closed", *[c for c in own if c not in ("copies", "closed")])).alias("m")
    return changes.groupBy("doc_hash", "session").agg(last).select("doc_hash", "session", *[F.col(f"m.{c}").alias(c) for c in own])


def late_rows(query: StreamingQuery) -> int:
    """Rows that came later than the watermark, over the progress that the session still holds."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
