"""Plumbing shared by the operators: shared storage, Arrow row mapping, tables."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vivaspark.operators.relational import HOT, join_by_key  # noqa: F401
from vivaspark.session import shared_folder

#: What separates words in every contract: space and the controls 9 to 13.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the folder all executors share and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches of texts have at most so many rows, on both sides of the pipe to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def arrow_rows(df: DataFrame, schema: T.StructType, make: Callable[[], Callable[..., Iterator[tuple]]], slice_rows: int = 512) -> DataFrame:
    """Apply a Python function to df's columns, rows in slices, through Arrow.

    make() runs once a task and returns f(*columns), each a list of Python
    values; f yields output tuples. Memory is that of slice_rows rows.
    """

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, to = make(), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                rows = list(f(*(c.to_pylist() for c in part.columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), to)], schema=to)

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that a fit on the driver has freed to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_fold(col: str, mod: int):
    """crc32 of an id written as text, modulo mod; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def crc_mod(value: object, mod: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % mod
