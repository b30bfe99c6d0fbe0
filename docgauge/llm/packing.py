"""Hierarchical multi-length packing of documents into training sequences.

A task tokenises its documents in order and packs them group by group (GROUP_TOKENS), so
nothing is shuffled and memory is bounded by a group and one document. Within a group:

1. full windows are cut off long documents;
2. what remains of each document is routed to the smallest context tier that holds it;
3. tiers are packed from the longest: a window starts with the tier's longest document and
   its gap is filled from shorter tiers, first with whole documents (best fit), then by cutting one;
4. the sequences are dealt to step groups so that attention cost is level.

Every window is filled to its tier, a power of two, so no sequence needs padding. The rest
of a task, less than one window of each tier, is cut into powers of two.

Defined cases: null and empty texts have the end id alone; repeated rows are packed as
often as they occur; an empty table gives an empty result. Which documents meet in a
sequence follows from the input's partitions, so a recomputed task gives the same rows.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, read, text_of
from .memory import tidy
from .tokens import default_vocabulary, encoder

WINDOW = 4096
TIERS = (128, 256, 512, 1024, 2048, 4096)
GROUP_TOKENS = 1 << 21
STEP_TOKENS = 1 << 18
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"


class Pool:
    """Remainders of documents by length; an entry is (length, order, document, start)."""

    def __init__(self, items):
        self.items = sorted(items)

    def longest(self):
        return self.items.pop()

    def best_fit(self, gap: int):
        """The longest whole remainder of at most gap."""
        k = bisect_right(self.items, (gap, float("inf")))
        return self.items.pop(k - 1) if k else None

    def cut(self, gap: int):
        """The first gap tokens of the shortest remainder over gap; what is left of it goes back."""
        k = bisect_left(self.items, (gap + 1,))
        if k == len(self.items):
            return None
        n, order, doc, start = self.items.pop(k)
        insort(self.items, (n - gap, order, doc, start + gap))
        return gap, order, doc, start


def tier_of(n: int, tiers=TIERS) -> int:
    return tiers[bisect_left(tiers, n)]


def pack_group(lengths: list[int], tiers=TIERS, last: bool = True):
    """Sequences of (document, start, length) pieces, and the remainders that wait for the next group.

    With last, nothing waits: what can't fill a window is cut into powers of two.
    """
    window, sequences, rest = tiers[-1], [], []
    for doc, n in enumerate(lengths):
        full = n // window
        sequences += [(window, [(doc, k * window, window)]) for k in range(full)]
        if n % window:
            rest.append((n % window, doc, doc, full * window))
    pool = Pool(rest)
    total = sum(x[0] for x in rest)
    while pool.items:
        tier = tier_of(pool.items[-1][0], tiers)
        if total < tier:
            if not last:
                break
            # Not enough left for this tier: cut everything to powers of two.
            gap_to, pieces = 1 << (total.bit_length() - 1), []
            tier = gap_to
        pieces, gap = [], tier
        if pool.items[-1][0] <= gap:
            n, _, doc, start = pool.longest()
            pieces.append((doc, start, n))
            gap -= n
        while gap:
            got = pool.best_fit(gap) or pool.cut(gap)
            n, _, doc, start = got
            pieces.append((doc, start, n))
            gap -= n
        total -= tier
        sequences.append((tier, pieces))
    return sequences, [(doc, start, n) for n, _, doc, start in pool.items]


def step_groups(sequences, step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each sequence: costly sequences first, each to the step with the least attention cost so far."""
    tokens = sum(tier for tier, _ in sequences)
    steps = [(0, 0, k) for k in range(max(1, round(tokens / step_tokens)))]
    cost = [sum(n * n for _, _, n in pieces) for _, pieces in sequences]
    out = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-sequences[i][0], -cost[i], i)):
        c, t, k = heapq.heappop(steps)
        out[i] = k
        heapq.heappush(steps, (c + cost[i] + sequences[i][0], t + sequences[i][0], k))
    return out


def _packer(path: str, tiers, group_tokens: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path)
        base = TaskContext.get().partitionId() << 34
        held: list[tuple] = []  # doc_id, ids, first id not yet placed, all its ids
        size, n_seq, n_step = 0, 0, 0

        def flush(last: bool):
            nonlocal held, size, n_seq, n_step
            sequences, waits = pack_group([len(ids) for _, ids, _, _ in held], tiers, last)
            steps = step_groups(sequences)
            cols = [[] for _ in range(9)]
            for (tier, pieces), step in zip(sequences, steps):
                offset = 0
                for doc, start, n in pieces:
                    doc_id, ids, first, all_ids = held[doc]
                    crc = zlib.crc32(ids[start : start + n].tobytes())
                    for c, v in zip(cols, (doc_id, first + start, n, crc, all_ids, base + n_seq, offset, tier, base + n_step + step)):
                        c.append(v)
                    offset += n
                n_seq += 1
            n_step += max(steps, default=-1) + 1
            held = [(held[doc][0], held[doc][1][start : start + n].copy(), held[doc][2] + start, held[doc][3]) for doc, start, n in sorted(waits)]
            size = sum(len(x[1]) for x in held)
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        end = np.array([end_id], "<u4")
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.ids(part.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    held.append((doc_id, ids, 0, len(ids)))
                    size += len(ids)
                    if size >= group_tokens:
                        yield flush(False)
        if held:
            yield flush(True)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, tiers=TIERS, group_tokens: int = GROUP_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; window is the length of its sequence, step_group its training step."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(tidy(_packer(vocabulary or default_vocabulary(), tuple(tiers), group_tokens, end_id), keep_caches=True), SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
