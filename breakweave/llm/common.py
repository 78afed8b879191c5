"""Helpers shared by the operators of this folder: tables, the shared scratch folder, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import drop, materialize, scratch_tables, shared_dir
from ..session import ship_package

__all__ = ["blocks", "drop", "free_name", "materialize", "md5_long", "md5_unit", "scratch_tables", "shared_dir", "table", "whole_rows", "with_free_names"]


#: Rows and bytes of one Arrow batch between Spark and a Python worker, for sessions with Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
#: Rows and bytes of text that a task works on at once.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Also readies the session for the operators' Python tasks: the package is
    sent to the executors, and batches of whole texts are kept small, which bounds a task's memory. These
    settings of the session stay; they change no result, and a session that has set them keeps its own."""
    ship_package(spark)
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if str(spark.conf.get(key, default)).lower() in (default, f"{default}b", "64mb", "64m"):
            spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterator[pa.RecordBatch], column: int, rows: int = BLOCK_ROWS, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many rows and, of more than one row, so many bytes in a column."""
    for batch in batches:
        i, whole = 0, batch.column(column)
        while i < batch.num_rows:
            k = min(rows, batch.num_rows - i)
            while k > 1 and whole.slice(i, k).nbytes > most:
                k = (k + 1) // 2
            yield batch.slice(i, k)
            i += k


def with_free_names(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to add, so extra input columns never clash."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that no column of the table has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_rows(df: DataFrame, name: str = "doc") -> F.Column:
    """All columns as one struct, beside which an operator's own columns can have any name."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias(name)


def md5_unit(*parts) -> F.Column:
    """A uniform double in (0, 1) from 52 bits of the md5 of the ``|``-joined parts (JVM only)."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def md5_long(*parts) -> F.Column:
    """A non-negative 60-bit long from the md5 of the ``|``-joined parts (JVM only)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")

