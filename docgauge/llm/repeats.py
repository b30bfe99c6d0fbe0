"""Which 64-bit hashes occur more than once in a corpus, as a sketch of bounded size.

Tasks send their hashes sorted, their leading five bytes or more, in blocks by leading bits; a block's counts
are exact up to chance collisions of what is sent. There are about four blocks for each partition of the input,
whatever its size, so a block is one task's bounded work, and the bytes sent grow with the blocks. Hashes that repeat go into a Bloom filter, and
those that are very frequent into a small table of logarithms. The filter never misses a
repeated hash; what it lets through by chance is for the caller to verify. Its size follows
the input up to MOST_BITS; beyond that more passes by chance, never less.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .memory import release, tidy_group

#: Hashes a task holds before it sends them; where there are many blocks, so many for each that a row isn't one hash alone.
FLUSH, FLUSH_PER_BLOCK = 1_000_000, 4
#: A block's hashes are at most about 2**BLOCK_BITS.
BLOCK_BITS = 23
MOST_BITS = 1 << 27
RANK_CELLS = 1 << 20
FREQUENT = 8
MOST_BLOCKS = 1 << 22
BLOCK = "block int, keys binary, counts binary"


def key_bytes(log_blocks: int) -> int:
    """How many leading bytes tell hashes apart: so many that one in 64 at most collides with another by chance."""
    return min(8, max(5, -(-(log_blocks + BLOCK_BITS + 6) // 8)))


def _planes(keys: np.ndarray, size: int) -> bytes:
    """The leading bytes of sorted keys, byte by byte position, which compresses well."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _of_planes(raw: bytes, size: int) -> np.ndarray:
    n = len(raw) // size
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, n).T
    return out.reshape(-1).view(">u8").astype(np.uint64)


def blocks(parts, log_blocks: int):
    """Rows of BLOCK for an iterable of hash arrays."""
    held, size = [], 0
    wide, flush = key_bytes(log_blocks), max(FLUSH, FLUSH_PER_BLOCK << log_blocks)

    def send():
        keys, counts = np.unique(np.concatenate(held) >> np.uint64(64 - 8 * wide), return_counts=True)
        keys = keys << np.uint64(64 - 8 * wide)
        counts = np.minimum(counts, 255).astype(np.uint8)
        cuts = np.searchsorted(keys, np.arange(1 << log_blocks, dtype=np.uint64) << np.uint64(64 - log_blocks))
        cuts = np.append(cuts, len(keys))
        full = np.flatnonzero(np.diff(cuts))
        spans = [(cuts[b], cuts[b + 1]) for b in full]
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([_planes(keys[a:z], wide) for a, z in spans], pa.binary()), pa.array([counts[a:z].tobytes() for a, z in spans], pa.binary())],
            names=["block", "keys", "counts"],
        )

    for keys in parts:
        if len(keys):
            held.append(keys)
            size += len(keys)
        if size >= flush:
            yield send()
            held, size = [], 0
    if size:
        yield send()


def _cell_bits(log_blocks: int) -> int:
    """Ranks are kept by so many leading bits, one cell a block at least."""
    return max(RANK_CELLS.bit_length() - 1, log_blocks)


@dataclass
class Repeats:
    """bits: the filter, block by block. ranks: log2 of the count of frequent hashes, at least; by leading bits."""

    log_blocks: int
    log_bits: int
    bits: np.ndarray
    ranks: np.ndarray

    def _places(self, keys: np.ndarray):
        """Three bits of each key within its block."""
        size = self.log_bits - self.log_blocks
        base = (keys >> np.uint64(64 - self.log_blocks)) << np.uint64(size)
        h = keys >> np.uint64(64 - 8 * key_bytes(self.log_blocks))
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            yield base + ((h * np.uint64(odd)) >> np.uint64(64 - size))

    def has(self, keys: np.ndarray) -> np.ndarray:
        """False where a key surely occurs once."""
        out = np.ones(len(keys), bool)
        at = np.arange(len(keys))
        for p in self._places(keys):
            hit = (self.bits[(p[at] >> np.uint64(3)).astype(np.int64)] >> (p[at] & np.uint64(7)).astype(np.uint8)) & 1 == 1
            out[at[~hit]] = False
            at = at[hit]
        return out

    def rank(self, keys: np.ndarray) -> np.ndarray:
        return self.ranks[(keys >> np.uint64(64 - _cell_bits(self.log_blocks))).astype(np.int64)]


def _count(log_blocks: int, log_bits: int):
    def run(table: pa.Table) -> pa.Table:
        size = 1 << (log_bits - log_blocks)
        block = table.column("block")[0].as_py()
        keys = np.concatenate([_of_planes(x.as_py(), key_bytes(log_blocks)) for x in table.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")]).astype(np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts, first)
        keys = keys[first]
        again = total > 1
        shape = Repeats(log_blocks, log_bits, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        flags = np.zeros(size, bool)
        for p in shape._places(keys[again]):
            flags[(p & np.uint64(size - 1)).astype(np.int64)] = True
        cells = 1 << (_cell_bits(log_blocks) - log_blocks)
        ranks = np.zeros(cells, np.uint8)
        often = total >= FREQUENT
        at = (keys[often] >> np.uint64(64 - _cell_bits(log_blocks))) & np.uint64(cells - 1)
        np.maximum.at(ranks, at.astype(np.int64), np.log2(total[often]).astype(np.uint8))
        return pa.table({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()), "ranks": pa.array([ranks.tobytes()], pa.binary()), "n": pa.array([int(total.sum())], pa.int64())})

    return run


def shape_for(n_parts: int) -> int:
    """The logarithm of how many blocks an input of so many partitions gets."""
    return max(4, min(MOST_BLOCKS.bit_length() - 1, (max(1, n_parts) - 1).bit_length() + 2))


def collect(rows: DataFrame, log_blocks: int, expected: int, most: int = MOST_BITS) -> Repeats:
    """The sketch of all hashes in rows (of BLOCK). expected: about how many; the driver gets at most most / 8 + RANK_CELLS bytes."""
    log_bits = max(log_blocks + 6, min(most.bit_length() - 1, max(1, 2 * expected).bit_length()))
    found = rows.groupBy("block").applyInArrow(tidy_group(_count(log_blocks, log_bits)), "block int, bits binary, ranks binary, n long").select("block", "bits", "ranks")
    size, cells = 1 << (log_bits - log_blocks - 3), 1 << (_cell_bits(log_blocks) - log_blocks)
    bits, ranks = np.zeros(size << log_blocks, np.uint8), np.zeros(cells << log_blocks, np.uint8)
    for batch in found.toArrow().to_batches():
        for block, b, r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            bits[block * size : (block + 1) * size] = np.frombuffer(b.as_buffer(), np.uint8)
            ranks[block * cells : (block + 1) * cells] = np.frombuffer(r.as_buffer(), np.uint8)
    del found
    release()
    return Repeats(log_blocks, log_bits, bits, ranks)


def expected(docs: DataFrame, most: int = MOST_BITS) -> int:
    """About how many words the input has, from the size that the plan tells; only the filter's size depends on it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1 << 16, min(most, size // 3))
