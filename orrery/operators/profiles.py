"""Pictures with a colour profile brought to sRGB.

A profile is parsed and compiled once for each digest, whatever number of
pictures has it: three curves of 256 entries to linear light and one matrix to
linear sRGB.  Pictures are joined to what was compiled and carry no profile.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pictures import readable

#: Linear sRGB in the profile connection space (D50), by rows X, Y, Z.
SRGB_D50 = np.array([[0.4360747, 0.3850649, 0.1430804], [0.2225045, 0.7168786, 0.0606169], [0.0139322, 0.0971045, 0.7141733]])
STEPS = 1 << 14  # of the table of the last curve
CURVES = {0: ("g",), 1: ("g", "a", "b"), 2: ("g", "a", "b", "c"), 3: ("g", "a", "b", "c", "d"), 4: ("g", "a", "b", "c", "d", "e", "f")}


class Invalid(ValueError):
    """No profile that can be used; the text is a stable code."""


def _fixed(data: bytes, at: int, n: int) -> np.ndarray:
    return np.array(struct.unpack(f">{n}i", data[at : at + 4 * n])) / 65536


def curve(data: bytes) -> np.ndarray:
    """A tone curve's values at 0 to 255, between 0 and 1."""
    x = np.arange(256) / 255
    if data[:4] == b"curv":
        (n,) = struct.unpack(">I", data[8:12])
        if n == 0:
            return x
        if n == 1:
            return x ** (struct.unpack(">H", data[12:14])[0] / 256)
        table = np.array(struct.unpack(f">{n}H", data[12 : 12 + 2 * n])) / 65535
        return np.interp(x, np.linspace(0, 1, n), table)
    if data[:4] == b"para":
        (kind,) = struct.unpack(">H", data[8:10])
        if kind not in CURVES:
            raise Invalid("invalid_icc_profile")
        p = dict(zip(CURVES[kind], _fixed(data, 12, len(CURVES[kind])), strict=True))
        power = lambda v: np.power(np.maximum(v, 0), p["g"])
        if kind == 0:
            return np.clip(power(x), 0, 1)
        if kind in (1, 2):
            add = p.get("c", 0.0)
            return np.clip(np.where(x >= -p["b"] / p["a"], power(p["a"] * x + p["b"]) + add, add), 0, 1)
        return np.clip(np.where(x >= p["d"], power(p["a"] * x + p["b"]) + p.get("e", 0.0), p["c"] * x + p.get("f", 0.0)), 0, 1)
    raise Invalid("invalid_icc_profile")


def compiled(profile: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(curves, matrix) to linear sRGB of a profile of grey or of RGB by a matrix; ``unsupported_icc_profile`` for tables of colours."""
    try:
        if profile[36:40] != b"acsp" or struct.unpack(">I", profile[:4])[0] > len(profile):
            raise Invalid("invalid_icc_profile")
        (n,) = struct.unpack(">I", profile[128:132])
        tags = {}
        for k in range(n):
            name, at, size = struct.unpack(">4sII", profile[132 + 12 * k : 144 + 12 * k])
            if at + size > len(profile):
                raise Invalid("invalid_icc_profile")
            tags[name] = profile[at : at + size]
        space = profile[16:20]
        if profile[20:24] != b"XYZ " or b"A2B0" in tags and not {b"rXYZ", b"kTRC"} & set(tags):
            raise Invalid("unsupported_icc_profile")
        to_srgb = np.linalg.inv(SRGB_D50)
        if space == b"GRAY":
            grey = curve(tags[b"kTRC"])
            return np.stack([grey] * 3), np.eye(3)
        if space != b"RGB ":
            raise Invalid("unsupported_icc_profile")
        columns = [_fixed(tags[c + b"XYZ"], 8, 3) for c in (b"r", b"g", b"b")]
        return np.stack([curve(tags[c + b"TRC"]) for c in (b"r", b"g", b"b")]), to_srgb @ np.stack(columns, axis=1)
    except (struct.error, KeyError, ValueError, ZeroDivisionError) as error:
        raise Invalid(str(error) if isinstance(error, Invalid) else "invalid_icc_profile") from error


def _encoded() -> np.ndarray:
    """sRGB's curve from linear light, in steps, as 8 bits."""
    y = np.arange(STEPS + 1) / STEPS
    return np.rint(255 * np.where(y <= 0.0031308, 12.92 * y, 1.055 * y ** (1 / 2.4) - 0.055)).astype(np.uint8)


def to_srgb(a: np.ndarray, curves: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A picture's colours in sRGB; alpha stays, grey becomes three channels."""
    alpha = a[..., -1:] if a.shape[2] in (2, 4) else a[..., :0]
    rgb = a[..., :3] if a.shape[2] >= 3 else np.repeat(a[..., :1], 3, axis=2)
    linear = np.stack([curves[c][rgb[..., c]] for c in range(3)], axis=-1) @ matrix.T
    return np.concatenate((_encoded()[np.rint(np.clip(linear, 0, 1) * STEPS).astype(np.int64)], alpha), axis=2)


def in_srgb(pictures: DataFrame, profile: str = "profile") -> DataFrame:
    """``pictures`` of the image source with ``width, height, nChannels, data`` in sRGB, without the profile's column, and ``error``.

    Pictures without a profile are taken for sRGB and stay as they are.  A
    profile that can't be read gives ``invalid_icc_profile``, one that is a
    table of colours ``unsupported_icc_profile``, an unreadable picture
    ``unreadable_picture``; all of them have null data.
    """
    keyed = pictures.withColumn("_digest", F.sha2(F.col(profile), 256))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, data in zip(batch["_digest"], batch["p"], strict=True):
                try:
                    curves, matrix = compiled(bytes(data))
                    rows.append((digest, curves.ravel().tolist(), matrix.ravel().tolist(), ""))
                except Invalid as error:
                    rows.append((digest, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["_digest", "_curves", "_matrix", "_bad"])

    one = keyed.where("_digest IS NOT NULL").groupBy("_digest").agg(F.first(profile).alias("p"))
    ready = one.mapInPandas(build, "_digest string, _curves array<double>, _matrix array<double>, _bad string")
    joined = keyed.drop(profile).join(ready, "_digest", "left")

    @F.pandas_udf("width int, height int, nChannels int, data binary, error string")
    def convert(p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in p.itertuples(index=False):
            try:
                if r.bad:
                    raise Invalid(r.bad)
                a = readable(r)
                if r.curves is not None:
                    a = to_srgb(a, np.asarray(r.curves, float).reshape(3, 256), np.asarray(r.matrix, float).reshape(3, 3))
                out = np.concatenate((a[..., 2::-1], a[..., 3:]), axis=2) if a.shape[2] >= 3 else a
                rows.append((a.shape[1], a.shape[0], a.shape[2], np.ascontiguousarray(out).tobytes(), ""))
            except ValueError as error:
                rows.append((None, None, None, None, str(error)))
        made = pd.DataFrame(rows, columns=["width", "height", "nChannels", "data", "error"])
        return made.astype({c: "Int32" for c in ("width", "height", "nChannels")})

    whole = F.struct("width", "height", "nChannels", "data", F.col("_curves").alias("curves"), F.col("_matrix").alias("matrix"), F.coalesce("_bad", F.lit("")).alias("bad"))
    rest = [c for c in pictures.columns if c not in ("width", "height", "nChannels", "data", profile)]
    return joined.withColumn("_s", convert(whole)).select(*rest, "_s.*")
