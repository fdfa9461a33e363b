"""Memory of the driver's Python process."""

from __future__ import annotations

import ctypes
from contextlib import suppress

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system, which Arrow's pool and the C library (if it is glibc) else hold for later use."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)
