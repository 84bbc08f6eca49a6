"""Scans of file trees on a file system that driver and executors share, as a Spark data source.

The driver lists only the upper folders, until there are enough subtrees to
deal out; tasks walk those.  A folder of many files is dealt to several tasks,
each of which asks the file system about its share of the names only.  Names
and suffixes are compared before a file is looked at, sizes before it is read,
and a file is read only if its content is wanted.
"""

from __future__ import annotations

import fnmatch
import json
import os
import stat
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

# Suffixes by what is done with the files.
PICTURES = [".jpg", ".jpeg", ".png", ".webp", ".avif", ".heic", ".heif", ".tiff", ".tif", ".bmp", ".gif", ".ico", ".ppm", ".tga"]
COMPRESSIBLE = [".jpg", ".jpeg", ".png", ".webp", ".avif", ".heic", ".heif", ".tiff", ".tif"]
WITH_METADATA = [".jpg", ".jpeg", ".png", ".webp", ".tiff", ".tif", ".heic", ".heif", ".avif"]
PAGES = [".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tiff", ".tif", ".webp", ".heic", ".heif", ".avif", ".ppm", ".tga", ".ico"]
VIDEOS = [".mp4", ".mov", ".mkv", ".webm", ".avi", ".m4v", ".wmv", ".flv", ".mpg", ".mpeg", ".ts", ".3gp"]

SUBTREES = 256  # folders the driver lists at most, to have tasks for all executors
SHARE = 10_000  # names of one folder in a task
BATCH, BATCH_BYTES = 1000, 32 << 20
LARGEST_SIZE = (1 << 63) - 1
LARGEST = (1 << 31) - 64  # bytes of a column's value

COLUMNS = "argument int, explicit boolean, given string, path string, name string, suffix string, length long, modified timestamp, device long, inode long, link boolean"


def suffix_of(name: str) -> str:
    """Lower-cased from the last dot on; names that only begin or end with one have none."""
    dot = name.rfind(".")
    return name[dot:].lower() if 0 < dot < len(name) - 1 else ""


@dataclass
class Part(D.InputPartition):
    """Some names of a folder, a folder with all below it, or a file that was named itself."""

    argument: int
    path: str
    kind: str  # "file", "flat" or "walk"
    share: int = 0
    shares: int = 1

    def __post_init__(self):
        super().__init__(self.path)


class TreeReader(D.DataSourceReader):
    def __init__(self, options):
        listed = lambda name: json.loads(options.get(name, "[]"))
        self.paths, self.suffixes = listed("paths"), set(listed("suffixes"))
        self.include, self.exclude = listed("include"), listed("exclude")
        self.recursive = options.get("recursive", "false") == "true"
        self.links = options.get("links", "explicit")
        self.exact = listed("exactSuffixes")  # of what a folder holds; cases count
        self.content = options.get("content", "false") == "true"
        self.least, self.most = int(options.get("least", 0)), int(options.get("most", LARGEST_SIZE))

    def partitions(self) -> list[Part]:
        out = []
        for k, given in enumerate(self.paths):
            if self.links == "none" and os.path.islink(given):
                continue
            if os.path.isfile(given):
                out.append(Part(k, given, "file"))
            elif os.path.isdir(given):
                out += self._subtrees(k, given)
        return out

    def _subtrees(self, k: int, top: str) -> list[Part]:
        waiting, out = [top], []
        for _ in range(SUBTREES):
            if not waiting:
                break
            folder = waiting.pop(0)
            names, below = 0, []
            for e in _listed(folder):
                names += 1
                if self.recursive and e.is_dir(follow_symlinks=False):
                    below.append(e.path)
            waiting += sorted(below)
            shares = max(1, -(-names // SHARE))
            out += [Part(k, folder, "flat", i, shares) for i in range(shares)]
        return out + [Part(k, folder, "walk") for folder in waiting]

    def read(self, part: Part | None) -> Iterator:
        import pyarrow as pa

        rows, size = [], 0
        for row in self._rows(part) if part else ():  # none: nothing is there to be read
            rows.append(row)
            size += len(row[-1] or b"") if self.content else 0
            if len(rows) >= BATCH or size >= BATCH_BYTES:
                yield _batch(pa, rows, self.content)
                rows, size = [], 0
        if rows:
            yield _batch(pa, rows, self.content)

    def _rows(self, part: Part) -> Iterator[tuple]:
        if part.kind == "file":
            yield from self._row(part.argument, part.path, os.path.basename(part.path), True)
            return
        waiting = [part.path]
        while waiting:
            folder = waiting.pop()
            for e in _listed(folder):
                if part.shares > 1 and zlib.crc32(os.fsencode(e.name)) % part.shares != part.share:
                    continue
                if e.is_dir(follow_symlinks=False):
                    if part.kind == "walk":
                        waiting.append(e.path)
                elif not e.is_symlink():
                    yield from self._row(part.argument, e.path, e.name, False)

    def _row(self, argument: int, path: str, name: str, explicit: bool) -> Iterator[tuple]:
        suffix = suffix_of(name)
        if self.suffixes and suffix not in self.suffixes or not explicit and self.exact and not any(name.endswith(x) for x in self.exact):
            return
        if not self._globbed(path, name):
            return
        try:
            own, real = os.lstat(path), os.path.realpath(path)
            found = os.stat(path)
        except OSError:
            return  # gone since it was listed
        if not stat.S_ISREG(found.st_mode) or not self.least <= found.st_size <= self.most:
            return
        row = (argument, explicit, path, real, name, suffix, found.st_size, int(found.st_mtime * 1_000_000), found.st_dev, found.st_ino, stat.S_ISLNK(own.st_mode))
        yield (*row, _content(real, found.st_size)) if self.content else row

    def _globbed(self, path: str, name: str) -> bool:
        hit = lambda globs: any(fnmatch.fnmatchcase(path, g) or fnmatch.fnmatchcase(name, g) for g in globs)
        return (not self.include or hit(self.include)) and not hit(self.exclude)


def _listed(folder: str) -> list:
    """Entries of a folder; none of one that can't be read or is gone."""
    try:
        with os.scandir(folder) as entries:
            return list(entries)
    except OSError:
        return []


def _content(path: str, size: int) -> bytes | None:
    if size > LARGEST:
        return None
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def _batch(pa, rows: list[tuple], content: bool):
    kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.bool_()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    if content:
        kinds.append(pa.binary())
        names.append("content")
    columns = [[_text(v) if pa.types.is_string(t) else v for v in c] for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _text(v: str) -> str:
    """Names that aren't UTF-8, with replacement characters."""
    return v.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class FileTree(D.DataSource):
    """``spark.read.format("file_tree")``; options hold JSON lists."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return COLUMNS + (", content binary" if self.options.get("content", "false") == "true" else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def files(spark: SparkSession, paths: list[str], suffixes: list[str] = (), recursive: bool = False, include: list[str] = (), exclude: list[str] = (), least: int = 0, most: int | None = None, links: str = "explicit", content: bool = False, exact: list[str] = ()) -> DataFrame:
    """One row for each time an argument names or holds a file: see ``COLUMNS``; with ``content`` its bytes.

    ``suffixes`` are lower case and tell any case; none means all.  A file is
    kept if its path as given or its name matches some ``include`` glob (where
    there are any) and no ``exclude`` one, and its size is within ``least`` and
    ``most``.  Links found in folders are skipped; those that are named
    themselves count, unless ``links`` is "none".  Folders that can't be read
    and files that are gone when they are looked at give no row.  ``content``
    is null for files of 2 GB and more.

    What selects files goes to the tasks that walk as options of the source.
    Filters aren't pushed down: Spark keeps what it pushed with the frame, so
    two filters of one frame in one query would both get the last one's rows.
    """
    spark.dataSource.register(FileTree)
    options = {"paths": paths, "suffixes": list(suffixes), "include": list(include), "exclude": list(exclude), "exactSuffixes": list(exact)}
    reader = spark.read.format("file_tree").options(**{k: json.dumps(v) for k, v in options.items()}).option("least", least)
    if most is not None:
        reader = reader.option("most", most)
    return reader.option("recursive", str(recursive).lower()).option("links", links).option("content", str(content).lower()).load()


def distinct_files(found: DataFrame) -> DataFrame:
    """One row a file that was found, by its resolved path: the first argument's."""
    rest = [c for c in found.columns if c != "path"]
    first = found.groupBy("path").agg(F.min_by(F.struct(*rest), F.struct("argument", F.split("given", "/"))).alias("_f"))
    return first.select("path", *[F.col(f"_f.{c}").alias(c) for c in rest])


def in_given_order(found: DataFrame) -> DataFrame:
    """Distinct files with ``position``: by argument, those of a folder by the parts of their paths.

    Positions come from ranges that are sorted apart and counted, so no task
    sees more than its range.
    """
    from ..operators.tables import written

    keys = ["argument", F.split("given", "/")]
    dealt = distinct_files(found).repartitionByRange(*keys, "path").sortWithinPartitions(*keys, "path")
    # the number of a row within its range, and of the ranges before it
    dealt = written(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)}))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b._range") < F.col("a._range"), "left").groupBy(F.col("a._range").alias("_range")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_range").withColumn("position", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def pictures(spark: SparkSession, paths: list[str], only: str | None = None, **more) -> DataFrame:
    """Distinct picture files; ``only`` one suffix, which then replaces the list of known ones."""
    return distinct_files(files(spark, paths, [_dotted(only)] if only else PICTURES, **more))


def duplicates_of(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """Picture files whose copies may be removed: no link counts, not even a named one."""
    return distinct_files(files(spark, paths, PICTURES, recursive, links="none"))


def page_pictures(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """Pictures for pages, in the order in which they were given first."""
    return in_given_order(files(spark, paths, PAGES, recursive))


def page_documents(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """PDFs in the order in which they were given first; in folders the suffix is lower case, named files may have any case."""
    return in_given_order(files(spark, paths, [".pdf"], recursive, exact=[".pdf"]))


def videos(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    return distinct_files(files(spark, paths, VIDEOS, recursive))


def _dotted(suffix: str) -> str:
    return "." + suffix.lower().lstrip(".")
