"""Pictures encoded to a budget of bytes: a ladder of palettes, of which the best that fits is kept.

A picture's histogram comes from its parts (tiles, or rows of the image source
that share a key) and is added up, so the palette is that of the whole;
palettes are cut from it by median.  Every rung of the ladder is encoded and
measured, since sizes need not fall with the number of colours.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pictures import readable
from .planning import best_of_ladder
from .tables import written

RUNGS = (256, 192, 128, 96, 64, 48, 32, 24, 16, 12, 8, 6, 4, 3, 2)
LEVELS = 5  # bits of a channel in the histogram


def _bins(rgb: np.ndarray) -> np.ndarray:
    x = rgb.reshape(-1, 3).astype(np.int64) >> (8 - LEVELS)
    return (x[:, 0] << 2 * LEVELS) | (x[:, 1] << LEVELS) | x[:, 2]


def _rgb(a: np.ndarray) -> np.ndarray:
    """Colours on white, grey as three channels."""
    if a.shape[2] in (2, 4):
        alpha = a[..., -1:].astype(np.int64)
        t = a[..., :-1] * alpha + 255 * (255 - alpha) + 128
        a = (((t >> 8) + t) >> 8).astype(np.uint8)
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a


def histograms(pictures: DataFrame, key: str) -> DataFrame:
    """(key, bin, n, r, g, b): counts and sums of colours in bins of five bits a channel, over all rows of a key; unreadable rows add nothing."""
    kind = pictures.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    rgb = _rgb(readable(r)).reshape(-1, 3)
                except ValueError:
                    continue
                bins, at, n = np.unique(_bins(rgb), return_inverse=True, return_counts=True)
                sums = [np.bincount(at, rgb[:, c].astype(float)).astype(np.int64) for c in range(3)]
                yield pd.DataFrame({"k": [r.k] * len(bins), "bin": bins, "n": n, "r": sums[0], "g": sums[1], "b": sums[2]})

    rows = pictures.select(F.col(key).alias("k"), "width", "height", "nChannels", "data").mapInPandas(run, f"k {kind}, bin long, n long, r long, g long, b long")
    return rows.groupBy("k", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "r", "g", "b"))).withColumnRenamed("k", key)


def median_cut(mean: np.ndarray, n: np.ndarray, colours: int) -> np.ndarray:
    """The box each colour falls in, boxes being halved by weight along their widest channel, the one with the largest spread times weight first."""
    box = np.zeros(len(mean), np.int64)

    def spread(k: int) -> float:
        own = mean[box == k]
        return float((own.max(axis=0) - own.min(axis=0)).max() * n[box == k].sum())

    worth = {0: spread(0)}
    while len(worth) < colours:
        k = max(worth, key=lambda x: (worth[x], -x))
        if worth[k] <= 0:
            break
        own = np.flatnonzero(box == k)
        channel = int((mean[own].max(axis=0) - mean[own].min(axis=0)).argmax())
        own = own[np.lexsort((own, mean[own, channel]))]
        half = np.searchsorted(np.cumsum(n[own]), n[own].sum() / 2) + 1
        cut = min(max(1, int(half)), len(own) - 1)
        while 0 < cut < len(own) and mean[own[cut], channel] == mean[own[cut - 1], channel]:
            cut += 1  # equal values stay together
        if cut >= len(own):
            cut = int(np.flatnonzero(mean[own, channel] == mean[own[-1], channel])[0])
        new = len(worth)
        box[own[cut:]] = new
        worth[k], worth[new] = spread(k), spread(new)
    return box


def palettes(histogram: DataFrame, key: str, rungs: tuple[int, ...] = RUNGS) -> DataFrame:
    """(key, colours, palette, lookup): for each rung the colours and which of them each bin gets (255 for bins that don't occur).

    A key's bins, at most 2^15, are cut in one task.
    """
    kind = histogram.schema[key].dataType.simpleString()

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        n, sums = rows["n"].to_numpy(np.int64), rows[["r", "g", "b"]].to_numpy(np.int64)
        out = []
        for colours in rungs:
            box = median_cut(sums / n[:, None], n, colours)
            weight = np.bincount(box, n)
            table = np.stack([np.rint(np.bincount(box, sums[:, c]) / weight) for c in range(3)], axis=1).astype(np.uint8)
            lookup = np.full(1 << 3 * LEVELS, 255, np.uint8)
            lookup[rows["bin"].to_numpy()] = box
            out.append((rows["k"].iloc[0], colours, table.tobytes(), lookup.tobytes()))
        return pd.DataFrame(out, columns=["k", "colours", "palette", "lookup"])

    out = histogram.withColumnRenamed(key, "k").groupBy("k").applyInPandas(cut, f"k {kind}, colours int, palette binary, lookup binary")
    return out.withColumnRenamed("k", key)


def filtered(lines: np.ndarray, unit: int) -> np.ndarray:
    """PNG lines with the filter (none, left, up, both halved) whose bytes are smallest in sum, line by line."""
    x = lines.astype(np.int16)
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[:, unit:], up[1:] = x[:, :-unit] if x.shape[1] > unit else 0, x[:-1]
    kinds = np.stack([x, x - left, x - up, x - ((left + up) >> 1)]).astype(np.uint8)
    cost = np.where(kinds < 128, kinds, 256 - kinds.astype(np.int64)).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((len(lines), 1 + lines.shape[1]), np.uint8)
    out[:, 0], out[:, 1:] = best, kinds[best, np.arange(len(lines))]
    return out


def packed_png(a: np.ndarray, palette: np.ndarray | None = None) -> bytes:
    """The smaller PNG of one without filters and one with the best of each line; of indices, if there is a palette, in as few bits as they need."""
    h, w, c = a.shape
    if palette is None:
        depth, kind, lines, extra = 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], a.reshape(h, w * c), b""
    else:
        depth, kind, c = next(d for d in (1, 2, 4, 8) if len(palette) <= 1 << d), 3, 1
        bits = (a[..., 0][:, :, None] >> np.arange(depth)[::-1] & 1).astype(np.uint8).reshape(h, -1)
        lines, extra = np.packbits(bits, axis=1), palette.tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    plain = np.concatenate((np.zeros((h, 1), np.uint8), lines), axis=1)
    body = min((zlib.compress(x.tobytes(), 9) for x in (plain, filtered(lines, c))), key=len)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + (chunk(b"PLTE", extra) if extra else b"") + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def encoded_to_budget(pictures: DataFrame, key: str, budget: str, size: str | None = None, rungs: tuple[int, ...] = RUNGS) -> DataFrame:
    """(key, outcome, colours, bytes, content, error, closest_size, attempts) of pictures of distinct keys.

    ``budget`` is a column of bytes; where the source's ``size`` (a column) is
    within it, it stays (``already_within_target``, no content).  Else the
    lossless PNG if it fits, else the one of most colours that does
    (``image_quality_n``), alpha on white; else ``target_size_unreachable``
    with the closest size.  Unreadable pictures have ``unreadable_picture``.
    """
    kind = pictures.schema[key].dataType.simpleString()
    rows = pictures.select(F.col(key).alias("k"), "width", "height", "nChannels", "data", F.col(budget).cast("long").alias("budget"), (F.col(size) if size else F.col(budget) + 1).cast("long").alias("size"))
    work = rows.where("size > budget AND budget > 0")
    ladder = palettes(histograms(work, "k"), "k", rungs)

    def lossless(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    yield pd.DataFrame({"k": [r.k], "colours": pd.array([None], "Int32"), "content": [packed_png(readable(r))]})
                except ValueError:
                    continue

    def rung(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                a = _rgb(readable(r))
                index = np.frombuffer(r.lookup, np.uint8)[_bins(a)].reshape(*a.shape[:2], 1)
                yield pd.DataFrame({"k": [r.k], "colours": pd.array([r.colours], "Int32"), "content": [packed_png(index, np.frombuffer(r.palette, np.uint8).reshape(-1, 3))]})

    made = f"k {kind}, colours int, content binary"
    tried = work.mapInPandas(lossless, made).union(work.join(ladder, "k").mapInPandas(rung, made))
    tried = written(tried.withColumn("bytes", F.octet_length("content").cast("long")))
    chosen = best_of_ladder(rows.select("k", "size", "budget"), tried.select("k", "colours", "bytes"), "k", "size", "budget", "colours", "bytes", max(rungs), min(rungs))
    found = tried.select("k", F.col("colours").alias("c"), "content")
    encoded = (F.col("outcome") == "lossless") | F.col("outcome").startswith("image")
    out = chosen.alias("x").join(found.alias("y"), (F.col("x.k") == F.col("y.k")) & F.col("x.colours").eqNullSafe(F.col("y.c")) & encoded, "left")
    unread = (F.col("error") == "target_size_unreachable") & F.col("attempts").isNull()
    error = F.when(unread, "unreadable_picture").otherwise(F.col("error"))
    return out.select(F.col("x.k").alias(key), "outcome", "colours", F.col("x.bytes").alias("bytes"), "content", error.alias("error"), "closest_size", "attempts")
