"""Tables that fill in a Python worker as it works, shared out between the tasks it serves."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}


def enter(owner: str, release: Callable[[], None] | None = None) -> None:
    """Begin a task of ``owner``: tables of other owners in this process go, and their memory with them; its own stay warm."""
    others = [n for n in _held if n != owner]
    for name in others:
        _held.pop(name)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library than glibc
            pass
    _held[owner] = release or (lambda: None)
