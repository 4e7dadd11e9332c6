"""Shared building blocks: the engine's tables and sweeps, and memory of Python workers."""

from __future__ import annotations

import ctypes

from tidemark.tables import carried, exists, fresh_path, range_dealt, scratch, shared_dir, shuffle_partitions, stash  # noqa: F401


def release_memory() -> None:
    """Give memory that a finished partition no longer needs back to the system: idle Python workers keep theirs otherwise."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
