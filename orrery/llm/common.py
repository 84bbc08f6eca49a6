"""Shared pieces of the training-data operators.

Words everywhere are maximal runs of bytes other than space and 0x09-0x0D,
after lower-casing A-Z only; ``bytes.lower().split()`` does exactly that.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components  # noqa: F401
from ..operators.tables import dropped, shared_dir, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def lower_ascii(col):
    return F.translate(col, UPPER, UPPER.lower())


def remainder(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that is free again back to the system: Python workers live on between tasks and stages."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


@contextlib.contextmanager
def no_collections():
    """No garbage collections while a task makes many objects and no cycles; later tasks of the worker have them again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
        release()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of fewer rows for what is computed inside: rows that hold whole sets or texts take much room."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)
