"""Memory of Python workers, which live on between tasks."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def give_back() -> None:
    """Hand freed memory of this worker back to the system, so that later stages do not add theirs on top.

    Freed Arrow buffers and texts otherwise stay with the allocators. Without
    ``malloc_trim`` in the C library only the first two steps are taken.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
