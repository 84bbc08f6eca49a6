"""Removing duplicates and bringing them back, on a file system all executors share.

A file that moves takes its new name by one link, or as a copy that appears
whole, and loses the old one afterwards; nothing is overwritten.  A task that
runs again finds what it has done, so lost executors do no harm.  New files are
published by ``sources.published``.
"""

from __future__ import annotations

import contextlib
import errno
import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for chunk in iter(lambda: f.read(CHUNK), b""):
            digest.update(chunk)
    return digest.hexdigest()


def moved_to(source: str, target: str, size: int, digest: str) -> str:
    """'published', 'there' (the same bytes have the name) or an error code; the source stays.

    A link where both names are on one device, elsewhere a copy in chunks that
    is compared with the digest before it gets its name.
    """
    folder = os.path.dirname(target)
    temporary = os.path.join(folder, f".{uuid.uuid4().hex}.part")
    try:
        os.makedirs(folder, exist_ok=True)
        try:
            os.link(source, temporary, follow_symlinks=False)
        except OSError as error:
            if error.errno not in (errno.EXDEV, errno.EPERM, errno.EMLINK, errno.ENOTSUP):
                raise
            with open(source, "rb") as f, open(temporary, "xb") as out:
                shutil.copyfileobj(f, out, CHUNK)
                out.flush()
                os.fsync(out.fileno())
        if not still_safe(temporary, size, digest):
            return "source_changed"
        try:
            os.link(temporary, target, follow_symlinks=False)  # fails if the name is taken
            return "published"
        except FileExistsError:
            return "there" if still_safe(target, size, digest) else "output_exists"
    except OSError:
        return "output_not_created"
    finally:
        with contextlib.suppress(OSError):
            os.unlink(temporary)


def still_safe(path: str, size: int, digest: str) -> bool:
    """Whether a path is still the regular file that was measured."""
    try:
        return not os.path.islink(path) and os.path.isfile(path) and os.path.getsize(path) == size and sha256_of(path) == digest
    except OSError:
        return False


def remove_duplicates(df: DataFrame, backup: str | None = None) -> DataFrame:
    """(duplicate, outcome, error) of (keep, duplicate, size, sha256, allocated): duplicates go once both files are what they were.

    With a ``backup`` folder they are moved there under their ``allocated``
    names (see ``planning.numbered``), never onto an existing file; without one
    they are deleted.  A duplicate that is gone already counts as done when the
    kept file is still right, so a task may run again.
    """

    def act(keep: str, duplicate: str, size: int, digest: str, name: str | None) -> tuple[str, str]:
        if os.path.abspath(keep) == os.path.abspath(duplicate):
            return "", "same_file"
        if not still_safe(keep, size, digest):
            return "", "keep_changed"
        target = os.path.join(backup, name) if backup and name else None
        if not os.path.lexists(duplicate):
            return ("gone", "") if target is None or still_safe(target, size, digest) else ("", "input_not_found")
        if not still_safe(duplicate, size, digest):
            return "", "duplicate_changed"
        if os.path.samefile(keep, duplicate):
            return "", "same_file"
        try:
            if backup is None:
                os.unlink(duplicate)
                return "deleted", ""
            if target is None:
                return "", "missing_backup_name"
            got = moved_to(duplicate, target, size, digest)
            if got not in ("published", "there"):
                return "", got
            os.unlink(duplicate)
            return "moved", ""
        except OSError:
            return "", "not_removed"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *act(k, d, int(s), h, n)) for k, d, s, h, n in zip(*(batch[c] for c in ("keep", "duplicate", "size", "sha256", "allocated")), strict=True)]
            yield pd.DataFrame(rows, columns=["duplicate", "outcome", "error"])

    named = df if "allocated" in df.columns else df.withColumn("allocated", F.lit(None).cast("string"))
    return named.select("keep", "duplicate", "size", "sha256", "allocated").mapInPandas(run, "duplicate string, outcome string, error string")


def restore(df: DataFrame) -> DataFrame:
    """(path, outcome, error) of (stored, path): backed-up files take their old names again, none is overwritten."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stored, path in zip(batch["stored"], batch["path"], strict=True):
                if not os.path.isfile(stored) or os.path.islink(stored):
                    out.append((path, "", "input_not_found"))
                    continue
                got = moved_to(stored, path, os.path.getsize(stored), sha256_of(stored))
                if got in ("published", "there"):
                    os.unlink(stored)
                out.append((path, "restored", "") if got in ("published", "there") else (path, "", got))
            yield pd.DataFrame(out, columns=["path", "outcome", "error"])

    return df.select("stored", "path").mapInPandas(run, "path string, outcome string, error string")
