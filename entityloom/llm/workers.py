"""What Python workers need: the package on their path, and one object that outlives a task."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Hashable
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows that go to a Python worker at once where Spark's default stands: texts are long.
BATCH_ROWS = "1000"


def share_path(spark: SparkSession) -> None:
    """Add the folder that holds the package to the workers' path.

    On a cluster the package is installed or sent along; the extra entry is
    then a folder that does not exist there, which Python ignores. Batches of
    rows are made smaller, unless the session has a size of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *(p for p in known if p)])


def give_back() -> None:
    """Return freed memory and cycles to the system, where the C library and Arrow can."""
    gc.collect()
    trim()


def trim() -> None:
    """Return freed memory alone: a look for cycles goes through all that a worker has imported."""
    with contextlib.suppress(Exception):
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """The worker's object for ``key``, made when another was kept before.

    Workers serve many stages; only what the present one uses stays in memory.
    """
    if key not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[key] = make()
    return _kept[key]
