"""Memory of Python workers, which live on between the stages of a job."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import cache
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import SparkSession

T = TypeVar("T")

#: Blocks of so many bytes go back to the system as soon as they are free. Fixed value of the C library's option.
LARGE, M_MMAP_THRESHOLD = 1 << 20, -3
#: Bytes of a batch that goes to a Python worker: several batches and what is made of them are held at a time.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's batches for Python by bytes, where it has not bounded them closer.

    A batch of 10,000 rows is as large as its texts; by default it may have 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower()
    size = int(now.rstrip("bkmg")) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("b")[-1:], 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@cache
def _library() -> ctypes.CDLL | None:
    """The C library, told to give large free blocks back at once; none where it has no such options."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        library = ctypes.CDLL(None)
        library.mallopt(M_MMAP_THRESHOLD, LARGE)
        return library if library.malloc_trim else None
    except (AttributeError, OSError):
        return None


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once for all batches of a function; it goes when a function of another key comes."""
    if key not in _held:
        lean()
        _held[key] = make()
    return _held[key]


def lean() -> None:
    """Let this process give free memory back, instead of keeping what its largest batch took.

    Called where a function that holds nothing meets a batch: a worker that goes from one function to the next
    then holds what it needs at the time. What functions before it ``held`` is dropped. Large blocks go back when
    they are free, smaller ones here, when the batch before is gone; not where the C library has no such options."""
    _held.clear()
    library = _library()
    if library is not None:
        library.malloc_trim(0)
