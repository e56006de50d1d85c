"""Memory of Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Gives freed memory back to the machine: workers stay for the tasks of later stages, and one that idles would keep all that it ever held."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
