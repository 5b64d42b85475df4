"""Bounds on what a Python worker holds, during a task and after it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch between Spark and Python, where the session doesn't say: texts are longer than most rows.
ROWS, _SETTING, _DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with batches of long texts; a worker that has finished gives its memory back.

    Workers go on to tasks of other operators, and what each leaves unused would add up.
    """
    conf = df.sparkSession.conf
    if conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        conf.set(_SETTING, str(ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Returns unused memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
