"""Python workers that give memory back.

Workers live on between tasks. Large arrays are asked from the system one by one, so they
return there when freed, and what the allocators still hold is released after each task.
"""

from __future__ import annotations

import ctypes
import functools

#: From this size on an allocation is mapped apart.
MAPPED = 2 << 20

try:
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD; a fixed value also stops its growth
except (OSError, AttributeError):  # another C library
    _libc = None


def release() -> None:
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


#: Caches of a worker that outlive tasks; whatever else runs in the worker empties them first.
CACHES: list = []


def tidy(run, keep_caches: bool = False):
    """A function over batches that releases memory when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        if not keep_caches:
            for c in CACHES:
                c.clear()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run):
    """The same for a function over one group's table."""

    def wrapped(table):
        out = run(table)
        release()
        return out

    return wrapped
