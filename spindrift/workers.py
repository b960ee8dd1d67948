"""What Python workers do between tasks: they are used again, so what a task leaves behind adds up."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa


def kept_in_worker(name: str, make: Callable[[], Any]) -> Any:
    """What make() gives, made once a Python worker and kept for its later tasks: tables that are dear to load.

    Functions travel by value, so their modules' globals are new in each task; a module of the worker's own isn't."""
    store = sys.modules.setdefault("__sp_kept", types.ModuleType("__sp_kept")).__dict__
    return store[name] if name in store else store.setdefault(name, make())


def release() -> None:
    """Gives memory that nothing uses any more back to the system, where its allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
        if trim is not None:
            trim(0)


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's function, of batches to batches, that gives its memory back when it ends."""

    @functools.wraps(run)
    def tidied(*args: Any) -> Iterator:
        yield from run(*args)
        release()

    return tidied
