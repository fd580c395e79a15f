"""Helpers that the corpus operators share, mostly Arrow plumbing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialize, release, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Data of at most this many bytes may be broadcast.
BROADCAST_BYTES = 16 << 20


def tidy() -> None:
    """Give freed memory back at a task's end: Python workers live on and would hold on to their largest stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that no other column can clash with working columns."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def task_id() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's strings as UTF-8 bytes, null as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterable], Iterator]:
    """Lift a function of one record batch to what mapInArrow takes, skipping empty batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return run


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(record: pa.RecordBatch, column: str, most_bytes: int = 16 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice's texts stay within ``most_bytes`` (or it is a single row)."""
    size = pc.fill_null(pc.binary_length(record.column(record.schema.get_field_index(column))), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(size):
        if i > start and (held + n > most_bytes or i - start >= most_rows):
            yield record.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(size):
        yield record.slice(start)
