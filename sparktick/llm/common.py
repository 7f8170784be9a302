"""Small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words: exactly what bytes.split() splits at.
WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators use; a null text becomes an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches of about `most_bytes` of `column`; a batch above that is cut by rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        share = max(1, batch.num_rows * most_bytes // max(1, batch.column(column).nbytes))
        for at in range(0, batch.num_rows, share):
            part = batch.slice(at, share)
            held.append(part)
            size += part.column(column).nbytes
            if size >= most_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`fn` for mapInArrow, with unused memory given back at the end of each task: Spark keeps Python workers for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not the GNU library
            pass

    return run
