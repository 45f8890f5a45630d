"""What Arrow functions share that keep their workers small: bounded batches, slices of them, memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: A worker gets its rows in Arrow batches of so many bytes at most (or of one row), however long the texts are.
BATCH_BYTES = 8 << 20
#: Of a batch, so many bytes (or one text) are Python objects at a time.
SLICE_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key, None)
    if given is None or not given.isdigit() or int(given) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(texts: pa.Array, most: int | None = None) -> Iterator[list[str]]:
    """All texts in order, in lists of at most ``most`` bytes or of one text; a null text is an empty one."""
    most = most or SLICE_BYTES
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield [t or "" for t in texts[at:stop].to_pylist()]
        at, before = stop, int(ends[stop - 1])


def trim() -> None:
    """Returns memory that is free to the system, where its C library can; a process else keeps what it once took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
