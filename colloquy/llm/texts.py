"""Byte-level text helpers shared by the operators; all run inside tasks on one text at a time."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.session import ship_package

#: White space that separates words: \x20 and \x09-\x0D, which is what bytes.split() cuts at.
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepared(spark: SparkSession) -> None:
    """Ships the package, and lets Spark hand texts to workers in batches of 2,000 rows where its default of 10,000 stands.

    Batches are bounded by rows, and texts are long: on both sides of the pipe the default takes five times the memory.
    """
    ship_package(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text of an Arrow column; null counts as an empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def parts(batches, rows: int = 1000):
    """Slices of the batches, so that a worker holds few texts besides the batch itself; afterwards memory goes back to the system.

    Workers outlive their tasks, and what they keep adds up with what the next operator needs.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def word_codes(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words of this list."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def map_texts(docs: DataFrame, new: str, compute: Callable[[list[bytes]], list], text: str = "text") -> DataFrame:
    """All columns of docs and the new ones (a DDL string), which compute() gives for a batch of texts.

    One pass in tasks over whole texts, no shuffle. An input column whose name clashes with a new one gives way to it.
    """
    prepared(docs.sparkSession)
    fields = StructType.fromDDL(new)
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    at = docs.columns.index(text)

    def run(batches):
        for part in parts(batches):
            rows = part.column(0)
            # The field of a slice of rows, not of all rows.
            columns = compute(byte_texts(rows.flatten()[at]))
            yield pa.RecordBatch.from_arrays([rows, *columns], names=["row", *fields.names])

    out = packed.mapInArrow(run, StructType([*packed.schema.fields, *fields.fields]))
    taken = {c.lower() for c in fields.names}
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in taken), *fields.names)
