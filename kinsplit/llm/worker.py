"""What a Python worker keeps from one task to the next: one thing at a time, and within bounds.

Workers outlive the stage they were started for, so what a stage keeps would add up with
what the next ones keep. Keeping another thing lets go of the one before.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable
from typing import Any

import pyarrow as pa

#: Bytes of the entries that a worker's cache may hold; it is emptied when it has more.
CACHE_BYTES = 32 << 20
#: Share of a dictionary that an entry takes, besides its key and value.
_SLOT = 100

_held: dict[str, Any] = {}


#: Of the C library, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Hand freed memory back to the system; tasks call it, as a worker's memory is never given back by itself."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def held(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once for all tasks that this worker runs under ``name``."""
    if name not in _held:
        _held.clear()
        release()
        _held[name] = make()
    else:
        release()
    return _held[name]


def let_go() -> None:
    """Keep nothing: for tasks that have no use of what an earlier stage kept."""
    _held.clear()
    release()


class Cache(dict):
    """A dictionary that is emptied before its entries take more than ``limit`` bytes."""

    def __init__(self, limit: int = CACHE_BYTES):
        super().__init__()
        self.limit, self.size = limit, 0

    def keep(self, key, value):
        """Enter a new key and return its value."""
        self.size += sys.getsizeof(key) + sys.getsizeof(value) + _SLOT
        if self.size > self.limit:
            self.clear()
            self.size = sys.getsizeof(key) + sys.getsizeof(value) + _SLOT
        self[key] = value
        return value
