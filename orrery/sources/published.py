"""Publishing files under their final names, as a Spark data source with a commit protocol.

Tasks write to a staging folder of their own below the output root, on the
same file system.  Only when all tasks are done, the driver links each staged
file to its name, which fails if the name is taken, and reports row by row.  An
attempt that is lost, repeated or speculative leaves nothing but staged files,
which go with the job; a job that fails publishes nothing.

The list of what is to be published is on disk before the first name is given,
so a driver that dies in between is made up for by ``recovered``: publishing
again finds the names that are its own already.
"""

from __future__ import annotations

import contextlib
import errno
import hashlib
import json
import os
import shutil
import stat
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from ..operators.tables import shared_dir

STAGING = ".publishing-"
CHUNK = 1 << 20
LINKERS = 16
OVERWRITE, KEEP = "overwrite", "keep"


class Unsafe(OSError):
    """A parent of the target is a link, or no folder, or lies outside the root."""


def opened_folder(root: str, parts: list[str], create: bool = True) -> int:
    """Descriptor of a folder below the root, going down one part at a time and through no link."""
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        for part in parts:
            if part in ("", ".", ".."):
                raise Unsafe("unsafe_path")
            if create:
                with contextlib.suppress(FileExistsError):
                    os.mkdir(part, dir_fd=at)
            try:
                below = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
            except OSError as error:
                raise Unsafe("unsafe_path") from error
            os.close(at)
            at = below
    except BaseException:
        os.close(at)
        raise
    return at


def below(root: str, path: str) -> list[str]:
    """Parts of a path below the root."""
    if not path.startswith(root.rstrip("/") + "/"):
        raise Unsafe("unsafe_path")
    parts = path[len(root.rstrip("/")) + 1 :].split("/")
    if any(p in ("", ".", "..") for p in parts):
        raise Unsafe("unsafe_path")
    return parts


def named(root: str, staged: str, target: str, overwrite: bool) -> str:
    """Give a staged file its name: 'published', 'there' (it has the name already) or an error code."""
    try:
        *folders, name = below(root, target)
        at = opened_folder(root, folders)
    except Unsafe:
        return "unsafe_path"
    try:
        with contextlib.suppress(FileNotFoundError):
            there, own = os.stat(name, dir_fd=at, follow_symlinks=False), os.lstat(staged)
            if not stat.S_ISREG(there.st_mode):
                return "output_not_regular_file"
            if (there.st_dev, there.st_ino) == (own.st_dev, own.st_ino):
                return "there"
            if not overwrite:
                return "output_exists"
            os.chmod(staged, stat.S_IMODE(there.st_mode))  # an overwritten file keeps its permissions
        if overwrite:  # by way of a second link, so that the staged file stays until the job ends
            spare = f".{uuid.uuid4().hex}.part"
            os.link(staged, spare, dst_dir_fd=at)
            os.replace(spare, name, src_dir_fd=at, dst_dir_fd=at)
        else:
            os.link(staged, name, dst_dir_fd=at, follow_symlinks=False)
        os.fsync(at)
        return "published"
    except FileExistsError:
        return "output_exists"
    except OSError as error:
        return "output_not_created" if error.errno != errno.ENOENT else "not_staged"
    finally:
        os.close(at)


@dataclass
class Staged(D.WriterCommitMessage):
    """Where a task's list of staged files is."""

    manifest: str


class PublishingWriter(D.DataSourceWriter):
    def __init__(self, options, schema):
        self.root, self.overwrite = os.path.abspath(options["root"]), options.get("existing", KEEP) == OVERWRITE
        self.report, self.columns = options.get("report"), [f.name for f in schema.fields]
        self.staging = os.path.join(self.root, STAGING + options.get("job", uuid.uuid4().hex))
        os.makedirs(self.staging, exist_ok=True)  # here only: a task that outlives its job finds it gone and ends

    def write(self, rows: Iterator) -> Staged:
        from pyspark import TaskContext

        task = TaskContext.get()
        own = os.path.join(self.staging, f"{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
        os.mkdir(own)
        manifest = os.path.join(own, "manifest")
        with open(manifest, "w") as listed:
            for n, row in enumerate(rows):
                entry = self._staged(os.path.join(own, str(n)), row)
                listed.write(json.dumps(entry) + "\n")
            listed.flush()
            os.fsync(listed.fileno())
        return Staged(manifest)

    def _staged(self, to: str, row) -> dict:
        """One row's bytes, or those of the file it names, in the staging folder."""
        row = dict(zip(self.columns, row, strict=True))
        path, content, source = row["path"], row.get("content"), row.get("source")
        entry = {"path": path, "staged": to, "bytes": 0, "sha256": None, "error": ""}
        try:
            if path is None:
                raise Unsafe("unsafe_path")
            below(self.root, path)
            if content is None and source is None:
                return entry | {"error": "missing_content"}
            digest = hashlib.sha256()
            with open(to, "xb") as out:
                for chunk in [bytes(content)] if source is None else _chunks(source):
                    digest.update(chunk)
                    entry["bytes"] += out.write(chunk)
                out.flush()
                os.fsync(out.fileno())
            if not entry["bytes"]:
                return entry | {"error": "empty_output"}
            return entry | {"sha256": digest.hexdigest()}
        except Unsafe:
            return entry | {"error": "unsafe_path", "bytes": 0}
        except OSError:
            return entry | {"error": "output_not_created" if source is None else "source_not_read", "bytes": 0}

    def commit(self, messages: list[Staged | None]) -> None:
        manifests = [m.manifest for m in messages if m]
        if not manifests:
            self._clear()
            return
        _kept(os.path.join(self.staging, "commit"), {"manifests": manifests, "overwrite": self.overwrite, "report": self.report})
        finished(self.root, self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for _ in range(50):  # tasks that are still being ended may add files while the folder is emptied
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.exists(self.staging):
                break
            time.sleep(0.1)


def _kept(path: str, value: dict) -> None:
    """A small JSON file, whole or not at all."""
    with open(path + ".part", "w") as f:
        json.dump(value, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".part", path)


def _chunks(source: str) -> Iterator[bytes]:
    with open(os.open(source, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
        yield from iter(lambda: f.read(CHUNK), b"")


def finished(root: str, staging: str) -> None:
    """Publish what a committed job staged, report it, and clear its staging folder."""
    with open(os.path.join(staging, "commit")) as f:
        job = json.load(f)
    if job["report"]:
        os.makedirs(job["report"], exist_ok=True)
    for n, manifest in enumerate(job["manifests"]):  # one task's files at a time
        with open(manifest) as f, ThreadPoolExecutor(LINKERS) as pool:
            entries = [json.loads(line) for line in f]
            got = list(pool.map(lambda e: e["error"] or named(root, e["staged"], e["path"], job["overwrite"]), entries))
        if job["report"]:
            to = os.path.join(job["report"], f"part-{n:05d}.json")
            with open(to + ".part", "w") as out:
                for e, outcome in zip(entries, got, strict=True):
                    good = outcome in ("published", "there")
                    out.write(json.dumps({"path": e["path"], "bytes": e["bytes"] if good else 0, "sha256": e["sha256"] if good else None, "outcome": "published" if good else "", "error": "" if good else outcome}) + "\n")
            os.replace(to + ".part", to)
    shutil.rmtree(staging, ignore_errors=True)


class PublishedFiles(D.DataSource):
    """``df.write.format("published_files")`` of (path, content) or (path, source) rows."""

    @classmethod
    def name(cls) -> str:
        return "published_files"

    def schema(self) -> str:
        return "path string, content binary, source string"

    def writer(self, schema, overwrite: bool) -> PublishingWriter:
        return PublishingWriter(self.options, schema)


def local_folder(address: str) -> str:
    """The path of a folder on a file system that all machines mount."""
    if "://" in address or address.startswith("file:"):
        kind, _, rest = address.partition(":")
        if kind != "file":
            raise ValueError(f"files are published to mounted file systems only, not to {kind}")
        return "/" + rest.lstrip("/")
    return address


REPORT = "path string, bytes long, sha256 string, outcome string, error string"


def publish(df: DataFrame, root: str, path: str | Column = "path", content: str | Column | None = "content", source: str | Column | None = None, overwrite: bool = False) -> DataFrame:
    """(path, bytes, sha256, outcome, error) of publishing every row below ``root``, now.

    A row's file has its ``content``, or is a copy of the file ``source``
    names, read in chunks.  A file appears whole or not at all and never takes
    a name that another one has, unless ``overwrite``; even then only regular
    files are replaced.  Of rows with one path, one is published and the others
    find the name taken.  Rows without content, with empty content, or with a
    path that isn't below the root (or leads there through a link) get an
    error.  The report is a table in the shared folder.
    """
    spark = df.sparkSession
    root = local_folder(root)
    os.makedirs(root, exist_ok=True)
    spark.dataSource.register(PublishedFiles)
    report = f"{local_folder(shared_dir(spark))}/published-{uuid.uuid4().hex}"
    col = lambda c, kind: (F.col(c) if isinstance(c, str) else c).cast(kind)
    rows = [col(path, "string").alias("path")]
    rows += [col(content, "binary").alias("content")] if source is None else [col(source, "string").alias("source")]
    write = df.select(*rows).write.format("published_files").mode("append").option("root", root).option("report", report)
    write.option("existing", OVERWRITE if overwrite else KEEP).save()
    os.makedirs(report, exist_ok=True)  # nothing was published
    return spark.read.schema(REPORT).json(f"file://{report}")


def recovered(root: str) -> list[str]:
    """Finish jobs that were committed when their driver died; returns the staging folders of others, which can be removed once no job runs."""
    rest = []
    for name in sorted(os.listdir(root)):
        if name.startswith(STAGING):
            staging = os.path.join(root, name)
            if os.path.exists(os.path.join(staging, "commit")):
                finished(root, staging)
            else:
                rest.append(staging)
    return rest


def copied(df: DataFrame, root: str, source: str, path: str, overwrite: bool = False) -> DataFrame:
    """Copies of files, published like :func:`publish`."""
    return publish(df, root, path, None, source, overwrite)


def written_tree(spark: SparkSession, rows: DataFrame, path: Column, content: Column) -> str:
    """A new folder in the shared one that holds a file for every row, at its ``path`` below it."""
    root = f"{local_folder(shared_dir(spark))}/tree-{uuid.uuid4().hex}"
    publish(rows, root, F.concat(F.lit(root + "/"), path), content)
    return root
