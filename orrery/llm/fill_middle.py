"""Fill-in-the-middle texts, cut at units found through a sparse checkpoint index.

A text is a sequence of units (lines with their ends).  While they are
counted, the byte and code-point offsets of every ``EVERY``-th unit are kept:
an index of one pair of numbers for so many units, whatever the text's length.
A cut after u units is found by a binary search for the last checkpoint at or
before u, and a short scan from there.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, table

EVERY = 64  # units between checkpoints
SEED, RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEWLINE = 10


class Checkpoints:
    """Lines of a text in UTF-8: how many there are, and where each begins."""

    def __init__(self, data: bytes, every: int = EVERY):
        self.data, self.every = data, every
        self.units, self.bytes, self.points = [0], [0], [0]
        bytes_ = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(bytes_ == NEWLINE) + 1
        self.n = len(ends) + bool(len(data) and data[-1] != NEWLINE)
        marks = ends[every - 1 :: every]
        at = points = 0
        for k, end in enumerate(marks.tolist()):
            points += _points(bytes_[at:end])
            at = end
            self.units.append((k + 1) * every)
            self.bytes.append(end)
            self.points.append(points)
        self.length = points + _points(bytes_[at:])

    def offsets(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which a unit begins; the text's ends for the number of units."""
        if unit >= self.n:
            return len(self.data), self.length
        k = bisect_right(self.units, unit) - 1
        at = self.bytes[k]
        for _ in range(unit - self.units[k]):
            at = self.data.index(b"\n", at) + 1
        return at, self.points[k] + _points(np.frombuffer(self.data, np.uint8, at - self.bytes[k], self.bytes[k]))


def _points(part: np.ndarray) -> int:
    """Code points: bytes that don't continue one."""
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def draws(key: str, seed: int) -> list[int]:
    """h1 to h4: the first four groups of eight hexadecimal digits."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(text: str | None, key: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, every: int = EVERY) -> tuple:
    """(n, form, prefix's code points, middle's, output) of a text."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    index = Checkpoints(data, every)
    h = draws(key, seed)
    if not data or h[2] % 100 >= rate or any(mark.encode() in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, text or ""
    first, second = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (a, at), (b, to) = index.offsets(first), index.offsets(second)
    prefix, middle, suffix = (part.decode("utf-8", "surrogatepass") for part in (data[:a], data[a:b], data[b:]))
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return index.n, form, at, to - at, output


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    Lines end behind "\\n"; h1 to h4 come from the sha256 of ``seed:key`` (of
    ``seed:`` alone for a null key).  The prefix ends after the smaller of
    h1 and h2 modulo n + 1 lines, the middle after the larger.  A text is left
    plain if it is empty (null is empty), contains a sentinel, or by h3 beyond
    ``rate`` percent; h4 chooses between spm and psm.  Repeated rows stay
    repeated; other columns are left out, whatever their names.  A task holds
    one small batch of texts at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [transformed(t, k or "", seed, rate, spm_rate) for k, t in zip(batch["key"], batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            for name in ("prefix_chars", "middle_chars"):
                out[name] = out[name].astype("Int64")
            out.insert(0, "key", batch["key"].to_numpy())
            yield out
            release()

    own = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    out = own.mapInPandas(run, "key string, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output, form):
    """Column: the text an output was made of.  No sentinel is in a text that was cut, so each stands where it was put."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = {
    "op13_fill_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || x || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || x || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
}
