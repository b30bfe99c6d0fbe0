"""Words and word windows of whole Arrow batches as 64-bit hashes, in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial over a
fixed random table of bytes modulo 2**64, read off running sums, then mixed; a window's hash is
the same over its words' hashes. Both depend on the words alone, never on where they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes handled at once; words of a document longer than this are gathered over several rounds.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_FOLDED = _RANDOM.copy()
_FOLDED[65:91] = _RANDOM[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95 | 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """base**k and base**-k modulo 2**64 for k up to what was asked."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            out = []
            for b in (self.base, self.inverse):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_bytes, _words = _Powers(_BASE), _Powers(_STEP)


def _chunk(data: np.ndarray, table: np.ndarray, breaks: np.ndarray):
    """Starts, ends and hashes of the words of data; breaks are offsets at which a document begins."""
    n = len(data)
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    inner = breaks[(breaks > 0) & (breaks < n)]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    up, down = _bytes.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * up, out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: pa.Array, fold: bool = False):
    """(hashes, starts, ends, firsts, data): words of all texts; firsts[i]:firsts[i + 1] are those of text i.

    starts and ends are offsets into data, the bytes of all texts.
    """
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count or not pa.types.is_large_string(texts.type) else texts
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8).copy()
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    offs -= offs[0]
    table, at, n = _FOLDED if fold else _RANDOM, 0, len(data)
    hashes, starts, ends = [], [], []
    while at < n:
        end = min(n, at + CHUNK_BYTES)
        if end < n:  # cut at white space or between documents, so that no word is split
            cut = np.flatnonzero(_SPACE[data[at:end]])
            doc = offs[np.searchsorted(offs, end, "right") - 1]
            stop = max(at + cut[-1] + 1 if len(cut) else 0, doc)
            while stop <= at:  # one word longer than a chunk
                more = np.flatnonzero(_SPACE[data[end : end + CHUNK_BYTES]])
                nxt = offs[np.searchsorted(offs, end, "right")]
                end = min(n, end + CHUNK_BYTES, nxt)
                stop = end if end in (n, nxt) else (end - CHUNK_BYTES + more[0] + 1 if len(more) else 0)
            end = int(stop)
        lo, hi = np.searchsorted(offs, [at, end])
        s, e, h = _chunk(data[at:end], table, offs[lo:hi] - at)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = end
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    starts, ends, hashes = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
    return hashes, starts, ends, np.searchsorted(starts, offs), data


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of hashes[i:i + k] for each i that has k words left."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _words.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def spans(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The hash of hashes[lo:hi] for each pair of bounds, whatever its length."""
    up, down = _words.upto(len(hashes))
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(hashes * up))
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def whole(hashes: np.ndarray) -> int:
    """The hash of a word sequence of any length."""
    return int(windows(hashes, len(hashes))[0]) if len(hashes) else 0


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20):
    """The batch in slices whose texts have about most bytes, one row at least."""
    texts = batch.column(column).cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
