"""What a Python worker keeps from task to task: the caches of one operator at a time.

Workers outlive tasks and serve one operator after another.  Each task asks for
its operator's cache first; a cache of another operator is given up then, and
the memory goes back to the system.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa

Cache = TypeVar("Cache")
_HELD: dict[tuple, object] = {}


def hold(key: tuple, build: Callable[[], Cache] = lambda: None) -> Cache:
    """The cache named ``key``, built if this worker does not have it; any other is dropped."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)
        _HELD[key] = build()
    return _HELD[key]
