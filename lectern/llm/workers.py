"""How this subpackage runs Python over Arrow batches in bounded memory.

A worker lives on from task to task and from operator to operator. So batches are bounded by
bytes, compiled state is that of one operator at a time, and what a task no longer needs goes
back to the system when the task ends.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Most bytes of one Arrow batch, unless the session asks for fewer.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}

_held: dict[tuple[str, Any], Any] = {}


def hold(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this worker until another owner or key comes."""
    if (owner, key) not in _held:
        _held.clear()
        _held[owner, key] = make()
    return _held[owner, key]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def _bounded(spark: SparkSession) -> None:
    size, unit = re.fullmatch(r"(-?\d+)\s*([bkmg]?)b?", spark.conf.get(_SETTING).lower()).groups()
    if not 0 < int(size) * _UNITS[unit] <= BATCH_BYTES:
        spark.conf.set(_SETTING, f"{BATCH_BYTES}b")


def within(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's work in a worker; state that other owners hold goes first."""
    for owner, key in [*_held]:
        if owner != holds:
            del _held[owner, key]
    try:
        yield from run(batches)
    finally:
        _give_back()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, holds: str = "") -> DataFrame:
    """``df.mapInArrow(run, schema)`` in bounded memory. ``holds`` names the owner of what ``run`` holds."""
    _bounded(df.sparkSession)

    @wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return within(run, holds, batches)

    return df.mapInArrow(tidy, schema)
