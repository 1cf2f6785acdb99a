"""One large object per Python worker.

Workers live on from task to task and from stage to stage.  What a task has learned (word tables, models)
serves the worker's later tasks, but a worker keeps only the last such object: building
another one lets the one before go first, so its memory is bounded by the largest, not by their sum.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def release() -> None:
    """Gives memory that is no longer in use back to the machine: Arrow keeps it for later batches."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """The object of this key, built if it is not the one held."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = build()
    return _held[key]
