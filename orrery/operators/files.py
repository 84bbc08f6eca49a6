"""Operators over scanned files: digests, copies and their removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tree
from . import planning, publish
from .dedup import first_by_identity
from .tables import written

CHUNK = 1 << 20


def file_digests(found: DataFrame, algorithm: str = "sha256", path: str = "path") -> DataFrame:
    """``found`` with ``digest`` and ``error``: files are read in chunks where they lie, their bytes never are rows.

    A file that can't be read has a null digest and the error ``unreadable``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for p in batch[path]:
                try:
                    d = hashlib.new(algorithm)
                    with open(p, "rb") as f:
                        for chunk in iter(lambda: f.read(CHUNK), b""):  # noqa: B023
                            d.update(chunk)
                    digests.append(d.hexdigest())
                except OSError:
                    digests.append(None)
            yield batch.assign(digest=digests, error=["unreadable" if d is None else "" for d in digests])

    from pyspark.sql import types as T

    fields = [T.StructField("digest", T.StringType()), T.StructField("error", T.StringType())]
    return found.mapInPandas(run, T.StructType([*found.schema.fields, *fields]))


def duplicate_files(found: DataFrame) -> DataFrame:
    """(keep, duplicate, sha256, size) of distinct scanned files: every copy, and the first path of its group.

    Only files whose size occurs again are read.  Names of one file (hard
    links) are no copies of each other: only its first name takes part.
    """
    once = first_by_identity(found.select("path", "length", "device", "inode"), "path", "device", "inode")
    several = once.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    hashed = file_digests(once.join(several, "length", "left_semi").select("path", "length")).where("error = ''")
    hashed = written(hashed)  # read once: the groups and their members come from the same digests
    keeps = hashed.groupBy("length", "digest").agg(F.min("path").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return hashed.join(keeps, ["length", "digest"]).where("path <> keep").select("keep", F.col("path").alias("duplicate"), F.col("digest").alias("sha256"), F.col("length").alias("size"))


def remove_copies(spark: SparkSession, paths: list[str], recursive: bool = False, backup: str | None = None) -> DataFrame:
    """(keep, duplicate, size, outcome, error): scans pictures, finds exact copies and removes them, into ``backup`` if given.

    What is removed is compared with its digest again just before (see
    ``publish.remove_duplicates``).  The report is written when the files are
    removed, so reading it again removes nothing.
    """
    copies = written(duplicate_files(tree.duplicates_of(spark, paths, recursive)))
    named = planning.numbered(copies.withColumn("name", planning.file_name(F.col("duplicate"))), "name", "duplicate")
    done = written(publish.remove_duplicates(named, backup))
    return copies.join(done, "duplicate").select("keep", "duplicate", "size", "outcome", "error")


def below(path: Column, root: str) -> Column:
    """A path without its root."""
    return F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
