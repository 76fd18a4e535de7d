"""Helpers that the training-data operators share: table reading, Arrow row sinks, staged tables."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.staging import ship, staged, unstage

__all__ = ["WORD", "Sink", "fresh", "map_arrow", "ship", "shuffle_partitions", "staged", "table", "unstage"]

#: Most rows and about the most bytes of one Arrow batch sent to Python.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
#: Python operators give their output on in batches of about this many bytes.
FLUSH_BYTES = 4 << 20
#: ASCII white space: the complement of the word pattern ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], *names: str) -> list[str]:
    """Column names like the given ones that are none of the columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, which bounds a Python worker's memory. Spark reads
    these two settings when the plan runs, so they are made for the session; what the user has set stands."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            conf.set(f"spark.sql.execution.arrow.{name}", str(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives free memory back to the system: a Python worker lives on after its task, beside the JVM and other workers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


class Sink:
    """Collects output rows by column and gives them on as bounded Arrow batches."""

    def __init__(self, **types: pa.DataType):
        self.schema = pa.schema(list(types.items()))
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.bytes = 0

    def add(self, *values, size: int = 64) -> bool:
        """True if the sink should be drained now."""
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.bytes += size
        return self.bytes >= FLUSH_BYTES

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, self.schema.types, strict=True)], schema=self.schema)
            self.clear()
