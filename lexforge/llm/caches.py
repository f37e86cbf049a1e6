"""Caches of Python workers. Spark hands one worker the tasks of many stages; it holds the caches of one operator."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_RELEASE: dict[str, Callable[[], None]] = {}
_holder: str | None = None


def register(owner: str, release: Callable[[], None]) -> None:
    """``release`` empties the module-level caches of ``owner``."""
    _RELEASE[owner] = release


def claim(owner: str) -> None:
    """Empty the caches of all operators but ``owner``, which is about to work, and give their memory back."""
    global _holder
    if owner == _holder:
        return
    for name, release in _RELEASE.items():
        if name != owner:
            release()
    if _holder is not None:
        _give_back()
    _holder = owner


def _give_back() -> None:
    """Freed memory stays with the process's allocators unless they are told to return it to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)
