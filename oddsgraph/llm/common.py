"""Pieces that several corpus operators share.

Every operator takes a DataFrame with at least ``doc_id`` and ``text`` and selects the
columns it needs first, so extra columns, whatever their names, never meet its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.session import cut, drop_folder

SLICE_BYTES = 1 << 20
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """``doc_id`` as long and ``text`` (null: empty), with ``more``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows, without copying the texts."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def over_slices(
    fn: Callable[[list[int], list[str]], dict[str, list]], schema: pa.Schema, limit: int = SLICE_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``fn(ids, texts)`` over slices of rows, so that memory follows the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for a, b in slices(utf8(column)[1], limit):
                out = fn(ids.slice(a, b - a).to_pylist(), column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def read_files(files: tuple[str, ...]) -> pa.Table:
    """Parquet files of a written table, in a task."""
    parts = []
    for path in files:
        store, inner = file_system(path)
        parts.append(pq.read_table(inner, filesystem=store))
    return pa.concat_tables(parts)


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``, once every reader has run."""
    files = df.inputFiles()
    if files:
        drop_folder(files[0].rsplit("/", 1)[0])


__all__ = ["LOWER", "cut", "drop_cut", "drop_folder", "file_system", "let", "over_slices", "read_documents", "read_files", "slices", "texts", "utf8"]
