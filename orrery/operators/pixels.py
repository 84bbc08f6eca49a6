"""Kernels on decoded pixels and on JPEG bytes: vectorised, a row at a time only where rows differ in shape."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raster(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def transform(a: np.ndarray, degrees: int = 0, flip: str | None = None) -> np.ndarray:
    """Clockwise rotation by quarter turns, then a horizontal or vertical flip."""
    if degrees % 90:
        raise ValueError("invalid_degrees")
    a = np.rot90(a, -(degrees // 90) % 4)
    return a[:, ::-1] if flip == "horizontal" else a[::-1] if flip == "vertical" else a


def oriented(a: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as its EXIF orientation (1 to 8) wants it seen."""
    steps = {2: (0, "horizontal"), 3: (180, None), 4: (0, "vertical"), 5: (90, "horizontal"), 6: (90, None), 7: (270, "horizontal"), 8: (270, None)}
    return transform(a, *steps[orientation]) if orientation in steps else a


def flatten(a: np.ndarray, background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """RGBA on a colour."""
    alpha = a[..., 3:4].astype(float) / 255
    return np.rint(a[..., :3] * alpha + np.array(background) * (1 - alpha)).astype(np.uint8)


def overlay(a: np.ndarray, mark: np.ndarray, x: int, y: int, opacity: int = 128) -> np.ndarray:
    """RGBA ``mark`` on RGB ``a`` at (x, y), its alpha times opacity / 255; what lies outside is cut."""
    out = a.astype(float)
    h, w = min(mark.shape[0], a.shape[0] - y), min(mark.shape[1], a.shape[1] - x)
    if h > 0 and w > 0:
        m = mark[:h, :w].astype(float)
        alpha = m[..., 3:4] / 255 * opacity / 255
        out[y : y + h, x : x + w] = out[y : y + h, x : x + w] * (1 - alpha) + m[..., :3] * alpha
    return np.rint(out).astype(np.uint8)


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area average where it shrinks, nearest where it grows."""
    def spans(n: int, m: int) -> list[tuple[int, int]]:
        return [(i * n // m, max(i * n // m + 1, (i + 1) * n // m)) for i in range(m)]

    rows = np.stack([a[p:q].mean(axis=0) for p, q in spans(a.shape[0], height)])
    return np.rint(np.stack([rows[:, p:q].mean(axis=1) for p, q in spans(a.shape[1], width)], axis=1)).astype(np.uint8)


def grey(a: np.ndarray) -> np.ndarray:
    """Luma of RGB with the usual weights."""
    return np.rint(a[..., 0] * 0.299 + a[..., 1] * 0.587 + a[..., 2] * 0.114).astype(np.uint8) if a.shape[2] >= 3 else a[..., 0]


#: The next marker in coded data: neither a stuffed byte nor a restart, behind any number of fill bytes.
_MARKER = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]", re.DOTALL)


def strip_jpeg(data: bytes) -> bytes:
    """A JPEG without its APP1-APP15 and comment segments but colour profiles (APP2) and how colours are coded (APP14); the picture's own segments and scans stay byte for byte.

    Raises ValueError for what is no whole JPEG.
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("not_a_jpeg")
    out, at = [b"\xff\xd8"], 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("broken_jpeg")
        name = at
        while name < len(data) and data[name] == 0xFF:
            name += 1
        if name >= len(data):
            break
        kind = data[name]
        if kind == 0xD9:
            return b"".join((*out, b"\xff\xd9"))
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            out.append(bytes((0xFF, kind)))
            at = name + 1
            continue
        if name + 3 > len(data):
            break
        (size,) = struct.unpack(">H", data[name + 1 : name + 3])
        end = name + 1 + size
        if size < 2 or end > len(data):
            break
        told = 0xE1 <= kind <= 0xEF or kind == 0xFE
        if not told or kind == 0xEE or kind == 0xE2 and data.startswith(b"ICC_PROFILE\0", name + 3):
            out.append(b"\xff" + data[name:end])
        at = end
        if kind == 0xDA:  # coded data, up to the next marker
            found = _MARKER.search(data, at)
            if not found:
                break
            out.append(data[at : found.start()])
            at = found.start()
    raise ValueError("truncated_jpeg")


def strip_jpegs(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with ``stripped`` bytes and an ``error`` code."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch:
                try:
                    rows.append((strip_jpeg(bytes(b)), "") if b is not None else (None, "missing_input"))
                except ValueError as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["stripped", "error"])

    return df.withColumn("_s", F.pandas_udf(run, "stripped binary, error string")(F.col(content))).withColumns({"stripped": F.col("_s.stripped"), "error": F.col("_s.error")}).drop("_s")


def samples(df: DataFrame, size: int = 8) -> DataFrame:
    """(origin, samples): size x size grey means of decoded pictures; null for those that couldn't be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [
                grey(raster(bytes(r.data), r.width, r.height, r.nChannels)[..., ::-1] if r.nChannels == 3 else raster(bytes(r.data), r.width, r.height, r.nChannels)) if r.width > 0 else None
                for r in batch.itertuples()
            ]
            yield pd.DataFrame({"origin": batch["origin"], "samples": [None if a is None else resized(a[..., None], size, size).ravel().astype(int).tolist() for a in got]})

    return df.select("origin", "width", "height", "nChannels", "data").mapInPandas(run, "origin string, samples array<int>")
