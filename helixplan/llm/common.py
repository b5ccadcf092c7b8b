"""Small shared parts of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a record batch that a Python operator works on at a time, so that its own arrays stay small.
SLICE_ROWS = 256
SLICE_BYTES = 4 << 20

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. A text of single bytes takes the byte-wise path of ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def fold(key: Column, parts: int) -> Column:
    """``crc32`` of a key written as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def slices(batches: Iterator[pa.RecordBatch], size_of: str, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that column ``size_of`` holds about ``SLICE_BYTES`` at most (a single row may hold more)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(size_of))
        at, n = 0, batch.num_rows
        while at < n:
            step = min(rows, n - at)
            while step > 1 and column.slice(at, step).nbytes > SLICE_BYTES:
                step //= 2
            yield batch.slice(at, step)
            at += step

