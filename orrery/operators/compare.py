"""Comparison of sources and candidates, and the gate on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import psnr, quality_rating, ssim

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
BLUR = 5  # radius of the blur whose mean stands for the local one


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of equal length."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(square, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def compare(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with mse, psnr, whole-array ssim and the rating, of plain sample arrays; :func:`compare_pictures` has colours, alpha and blurred means."""
    x, y = F.col(a), F.col(b)
    n = F.size(x)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double")) / n
    out = pairs.withColumns({"mse": mse(x, y), "_ma": mean(x), "_mb": mean(y)})
    spread = lambda p, q, mp, mq: F.aggregate(F.zip_with(p, q, lambda s, t: (s.cast("double") - mp) * (t.cast("double") - mq)), F.lit(0.0), lambda s, e: s + e) / n
    ma, mb = F.col("_ma"), F.col("_mb")
    out = out.withColumn("ssim", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ssim(ma, mb, spread(x, x, ma, ma), spread(y, y, mb, mb), spread(x, y, ma, mb)))))
    out = out.withColumn("psnr", psnr(F.col("mse"))).drop("_ma", "_mb")
    return out.withColumn("rating", quality_rating(F.col("ssim"), F.col("psnr"), F.col("mse")))


def similarity(ma, mb, va, vb, cab):
    """SSIM of means, variances and the covariance."""
    return (2 * ma * mb + C1) * (2 * cab + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def blurred(plane: np.ndarray, radius: float = BLUR, passes: int = 3) -> np.ndarray:
    """A Gaussian blur of 8-bit samples by box blurs with fractional ends, borders repeated, each pass rounded to 8 bits."""
    variance = radius * radius / passes
    whole = int(np.floor((np.sqrt(12.0 * variance + 1.0) - 1.0) / 2.0))
    part = (2 * whole + 1) * (whole * (whole + 1) - 3.0 * variance) / (6.0 * (variance - (whole + 1) ** 2))
    inner = int((1 << 24) / (2 * (whole + part) + 1))
    outer = ((1 << 24) - (2 * whole + 1) * inner) // 2
    out = plane.astype(np.int64)
    for _ in range(2):  # along rows, then along columns
        for _ in range(passes):
            n = out.shape[1]
            wide = np.pad(out, ((0, 0), (whole + 1, whole + 1)), mode="edge")
            sums = np.cumsum(np.pad(wide, ((0, 0), (1, 0))), axis=1)
            middle = sums[:, 2 * whole + 2 : 2 * whole + 2 + n] - sums[:, 1 : n + 1]
            out = (middle * inner + (wide[:, :n] + wide[:, 2 * whole + 2 :]) * outer + (1 << 23)) >> 24
        out = out.T
    return out


def global_ssim(a: np.ndarray, b: np.ndarray) -> float:
    """SSIM of two planes of 8-bit samples, about the means of their blurred copies."""
    if not a.size:
        return 1.0
    ma, mb = blurred(a).mean(), blurred(b).mean()
    x, y = a - ma, b - mb
    return float(np.clip(similarity(ma, mb, (x * x).mean(), (y * y).mean(), (x * y).mean()), 0.0, 1.0))


def mean_block_ssim(a: np.ndarray, b: np.ndarray, block: int, stride: int) -> float | None:
    """The mean over sliding square blocks, blocks over the edge left out; None if none fits."""
    if min(a.shape) < block:
        return None
    x, y = (sliding_window_view(v.astype(float), (block, block))[::stride, ::stride] for v in (a, b))
    mean = lambda v: v.mean(axis=(2, 3))
    scores = []
    for p, q in zip(x, y, strict=True):  # a row of blocks at a time
        p, q = p[None], q[None]
        mx, my = mean(p), mean(q)
        dx, dy = p - mx[..., None, None], q - my[..., None, None]
        scores.append(similarity(mx, my, mean(dx * dx), mean(dy * dy), mean(dx * dy)))
    return float(np.concatenate(scores, axis=1).mean())


#: Shares of red, green and blue in brightness and the two colour differences, in 64ths rounded per value.
YCBCR = ((0.299, 0.587, 0.114), (-0.16874, -0.33126, 0.5), (0.5, -0.41869, -0.08131))


def planes(data: bytes, width: int, height: int, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """(RGBA, Y Cb Cr A) of 8-bit samples in row order: grey, grey and alpha, RGB or RGBA."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    rgb = px[..., :3] if channels >= 3 else np.repeat(px[..., :1], 3, axis=2)
    alpha = px[..., -1] if channels in (2, 4) else np.full((height, width), 255)
    table = lambda share: np.rint(share * 64 * np.arange(256)).astype(np.int64)
    rows = [sum(table(s)[rgb[..., k]] for k, s in enumerate(shares)) >> 6 for shares in YCBCR]
    y, cb, cr = (np.clip(v + (128 if k else 0), 0, 255) for k, v in enumerate(rows))
    return np.concatenate((rgb, alpha[..., None]), axis=2), np.stack((y, cb, cr, alpha))


def picture_scores(a: tuple, b: tuple, block: int = 64) -> tuple[float, float, float]:
    """(mse, global ssim, block ssim) of two pictures (data, width, height, channels) of one size.

    Errors are averaged over red, green, blue and alpha; the similarity is that
    of the worst of brightness, the colour differences and alpha.  Pictures
    smaller than a block have the global value for both.
    """
    (rgba, x), (other, y) = planes(*a), planes(*b)
    mse = float(((rgba - other) ** 2).mean(axis=(0, 1)).mean()) if rgba.size else 0.0
    whole = min(global_ssim(p, q) for p, q in zip(x, y, strict=True))
    blocks = [v for p, q in zip(x, y, strict=True) if (v := mean_block_ssim(p, q, block, block // 2)) is not None]
    return mse, whole, float(np.clip(min(blocks), 0.0, 1.0)) if blocks else whole


def compare_pictures(pairs: DataFrame, a: str, b: str, block: int = 64) -> DataFrame:
    """``pairs`` with mse, psnr, ssim, block_ssim, rating and error of two columns of struct(data, width, height, nChannels).

    Null, undecodable (negative width) and differently sized pictures get an
    error and nulls; rows and other columns are kept.
    """
    fields = ["data", "width", "height", "nChannels"]

    @F.pandas_udf("mse double, ssim double, block_ssim double, error string")
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p, q in zip(x[fields].itertuples(index=False), y[fields].itertuples(index=False), strict=True):
            if p.data is None or q.data is None or not (p.width >= 0 and q.width >= 0):
                out.append((None, None, None, "unreadable_picture"))
            elif (p.width, p.height) != (q.width, q.height):
                out.append((None, None, None, "size_mismatch"))
            else:
                out.append((*picture_scores(*((v.data, int(v.width), int(v.height), int(v.nChannels)) for v in (p, q)), block), ""))
        return pd.DataFrame(out, columns=["mse", "ssim", "block_ssim", "error"])

    some = lambda c: F.coalesce(F.col(c), F.struct(F.lit(None).cast("binary").alias("data"), F.lit(-1).alias("width"), F.lit(-1).alias("height"), F.lit(0).alias("nChannels")))
    picture = lambda c: F.struct(*(some(c)[f].alias(f) for f in fields))
    out = pairs.withColumn("_scores", run(picture(a), picture(b))).withColumns({k: F.col(f"_scores.{k}") for k in ("mse", "ssim", "block_ssim", "error")}).drop("_scores")
    out = out.withColumn("psnr", F.when(F.col("mse").isNotNull(), psnr(F.col("mse"))))
    return out.withColumn("rating", F.when(F.col("mse").isNotNull(), quality_rating(F.col("block_ssim"), F.col("psnr"), F.col("mse"))))


TILE = 512  # lines and columns of a tile without its halo
BLOCK, STRIDE = 64, 32
HALO = 32  # beyond a tile: of its last blocks, and more than three passes of the blur reach
TILES = "height int, width int, tile_y int, tile_x int, top int, left int, tile_height int, tile_width int, nChannels int, data binary"
MOMENTS = ["n", "ba", "bb", "sx", "sy", "sxx", "syy", "sxy", "blocks", "scores"]


def tiles(pictures: DataFrame, key: str, size: int = TILE) -> DataFrame:
    """(key, ...TILES): pictures of the image source cut into tiles with a halo of their neighbours' pixels; unreadable ones give no tile.

    ``size`` is a multiple of the stride of blocks.  Pictures that don't fit a
    row can be brought as such tiles to :func:`compare_tiles` from the start.
    """
    if size % STRIDE:
        raise ValueError("tile size: a multiple of the stride of blocks")
    kind = pictures.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.data is None or not (r.height > 0 and r.width > 0) or len(r.data) != r.height * r.width * r.nChannels:
                    continue
                h, w, c = int(r.height), int(r.width), int(r.nChannels)
                a = np.frombuffer(r.data, np.uint8).reshape(h, w, c)
                for y in range(-(-h // size)):
                    rows = []
                    for x in range(-(-w // size)):
                        top, left = max(0, y * size - HALO), max(0, x * size - HALO)
                        part = a[top : (y + 1) * size + HALO, left : (x + 1) * size + HALO]
                        rows.append((r.k, h, w, y, x, top, left, *part.shape[:2], c, part.tobytes()))
                    yield pd.DataFrame(rows, columns=["k", *(f.split()[0] for f in TILES.split(", "))])

    out = pictures.select(F.col(key).alias("k"), "height", "width", "nChannels", "data").mapInPandas(run, f"k {kind}, {TILES}")
    return out.withColumnRenamed("k", key)


def tile_moments(a: np.ndarray, b: np.ndarray, inner: tuple[slice, slice], origin: tuple[int, int], size: int) -> list[tuple]:
    """What two planes of a tile add to a picture's sums, without the halo; ``origin`` is where the array begins in the picture."""
    x, y = a[inner].astype(np.int64), b[inner].astype(np.int64)
    ba, bb = int(blurred(a)[inner].sum()), int(blurred(b)[inner].sum())
    first = [-(-(origin[k] + inner[k].start) // STRIDE) * STRIDE - origin[k] for k in range(2)]
    # blocks that begin in the tile, and are whole
    spans = [range(first[k], min(inner[k].stop, a.shape[k] - BLOCK + 1), STRIDE) for k in range(2)]
    scores = 0.0
    if len(spans[0]) and len(spans[1]):
        reach = [slice(s[0], s[-1] + BLOCK) for s in spans]
        scores = mean_block_ssim(a[reach[0], reach[1]], b[reach[0], reach[1]], BLOCK, STRIDE) * len(spans[0]) * len(spans[1])
    return [x.size, ba, bb, int(x.sum()), int(y.sum()), int((x * x).sum()), int((y * y).sum()), int((x * y).sum()), len(spans[0]) * len(spans[1]), float(scores)]


def compare_tiles(a: DataFrame, b: DataFrame, key: str, size: int = TILE) -> DataFrame:
    """(key, tiles, mse, psnr, ssim, block_ssim, rating, error) of pictures that come as :func:`tiles`: what :func:`compare_pictures` has for whole ones.

    A pair of tiles gives sums (of values, squares, products, blurred values
    and blocks' similarities) that add up to the picture's; no row is larger
    than a tile.  Pictures of different sizes have ``size_mismatch``, those of
    which a tile is missing on one side ``tile_missing``.
    """
    names = [f.split()[0] for f in TILES.split(", ")]
    side = lambda t, n: t.select(key, "tile_y", "tile_x", F.struct(*names).alias(n))
    pairs = side(a, "a").join(side(b, "b"), [key, "tile_y", "tile_x"], "full")
    fields = ", ".join(f"{m} array<{'double' if m == 'scores' else 'long'}>" for m in MOMENTS)

    @F.pandas_udf(f"squares long, values long, error string, {fields}")
    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r, s in zip(p.itertuples(index=False), q.itertuples(index=False), strict=True):
            if r.data is None or s.data is None:
                out.append((None, None, "tile_missing", *[None] * len(MOMENTS)))
                continue
            if (r.height, r.width) != (s.height, s.width):
                out.append((None, None, "size_mismatch", *[None] * len(MOMENTS)))
                continue
            (rgba, x), (other, y) = (planes(t.data, int(t.tile_width), int(t.tile_height), int(t.nChannels)) for t in (r, s))
            at = (int(r.tile_y) * size - int(r.top), int(r.tile_x) * size - int(r.left))
            end = (min(size, int(r.height) - int(r.tile_y) * size), min(size, int(r.width) - int(r.tile_x) * size))
            inner = tuple(slice(f, f + n) for f, n in zip(at, end, strict=True))
            each = [tile_moments(v, w, inner, (int(r.top), int(r.left)), size) for v, w in zip(x, y, strict=True)]
            squares = int(((rgba[inner] - other[inner]) ** 2).sum())
            out.append((squares, 4 * end[0] * end[1], "", *(list(m) for m in zip(*each, strict=True))))
        return pd.DataFrame(out, columns=["squares", "values", "error", *MOMENTS])

    whole = lambda n: F.struct(*(F.col(f"{n}.{f}").alias(f) for f in names))
    scored = pairs.select(key, run(whole("a"), whole("b")).alias("m"))
    sums = [F.sum(F.get(f"m.{m}", F.lit(c))).alias(f"{m}{c}") for c in range(4) for m in MOMENTS]
    out = scored.groupBy(key).agg(F.count("*").alias("tiles"), F.max("m.error").alias("error"), (F.sum("m.squares") / F.sum("m.values")).alias("mse"), *sums)

    def channel(c: int):
        v = {m: F.col(f"{m}{c}").cast("double") for m in MOMENTS}
        n, ma, mb = v["n"], v["ba"] / v["n"], v["bb"] / v["n"]
        about = lambda xy, x, y, p, q: v[xy] / n - q * (v[x] / n) - p * (v[y] / n) + p * q
        one = similarity(ma, mb, about("sxx", "sx", "sx", ma, ma), about("syy", "sy", "sy", mb, mb), about("sxy", "sx", "sy", ma, mb))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), one)), F.when(v["blocks"] > 0, v["scores"] / v["blocks"])  # null: no block

    each = [channel(c) for c in range(4)]
    ssim_ = F.least(*(g for g, _ in each))
    # all channels have as many blocks; without any the whole counts
    block = F.when(F.col("blocks0") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), *(b for _, b in each)))).otherwise(ssim_)
    good = F.col("error") == ""
    out = out.select(key, "tiles", *(F.when(good, c).alias(n) for c, n in ((F.col("mse"), "mse"), (ssim_, "ssim"), (block, "block_ssim"))), "error")
    out = out.withColumn("psnr", F.when(good, psnr(F.col("mse"))))
    return out.withColumn("rating", F.when(good, quality_rating(F.col("block_ssim"), F.col("psnr"), F.col("mse"))))


def block_ssim(pairs: DataFrame, key: list[str], a: str, b: str, width: int, block: int, stride: int) -> DataFrame:
    """(key..., ssim): the mean over sliding square blocks, of single planes of ``width`` columns in row order; blocks over the edge are left out.

    Planes smaller than a block have their whole similarity.  Pairs of planes
    that aren't of one length, or not of whole lines, have none (null).
    """

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            if len(p) != len(q) or not len(p) or len(p) % width:
                out.append(None)
                continue
            p, q = (np.asarray(v, float).reshape(-1, width) for v in (p, q))
            one = mean_block_ssim(p, q, block, stride)
            out.append(float(np.clip(global_ssim(p, q) if one is None else one, 0.0, 1.0)))
        return pd.Series(out, dtype=float)

    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*key, run(F.col(a), F.col(b)).alias("ssim"))


def gate(df: DataFrame, checks: dict[str, Column], min_ssim: float = 0.99, min_psnr: float | None = None) -> DataFrame:
    """``df`` with the checks as a map, whether all pass, and the error code."""
    entries = F.create_map(*(x for k, v in checks.items() for x in (F.lit(k), F.coalesce(v, F.lit(False)))))
    out = df.withColumn("checks", entries)
    good = F.forall(F.map_values("checks"), lambda v: v) & F.coalesce(F.col("ssim") >= min_ssim, F.lit(False))
    if min_psnr is not None:
        good &= F.coalesce(F.col("psnr") >= min_psnr, F.lit(False))
    return out.withColumn("passed", good).withColumn("error", F.when(good, "").otherwise("quality_gate_failed"))


def worst(df: DataFrame, key: str) -> DataFrame:
    """The worst frame of each key; it was sampled if any of them was."""
    return df.groupBy(key).agg(F.min("ssim").alias("ssim"), F.min("psnr").alias("psnr"), F.bool_or("sampled").alias("sampled"))


def bounding_box(df: DataFrame, key: str, samples: str, width: int, height: int, fuzz: float, pad: int = 2) -> DataFrame:
    """(key, left, top, right, bottom) of what differs from the first sample by more than ``fuzz``; the whole picture if nothing does."""
    v = F.col(samples)
    first = F.get(v, F.lit(0)).cast("double")
    at = F.filter(F.transform(v, lambda x, i: F.when(F.abs(x.cast("double") - first) > fuzz, i)), lambda i: i.isNotNull())
    found = df.where(v.isNotNull()).select(key, at.alias("_at"))
    xs, ys = F.transform("_at", lambda i: i % width), F.transform("_at", lambda i: F.floor(i / width).cast("int"))
    low = lambda c: F.greatest(F.lit(0), F.coalesce(F.array_min(c) - pad, F.lit(0))).cast("int")
    high = lambda c, n: F.least(F.lit(n), F.coalesce(F.array_max(c) + 1 + pad, F.lit(n))).cast("int")
    return found.select(key, low(xs).alias("left"), low(ys).alias("top"), high(xs, width).alias("right"), high(ys, height).alias("bottom"))


def sample_statistics(df: DataFrame, key: str, values: Column) -> DataFrame:
    """(key, colours, entropy, deviation) a row with samples: distinct values (10,000 at most), entropy of their shares, population deviation."""

    @F.pandas_udf("colours long, entropy double, deviation double")
    def run(samples: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in samples:
            out = []
            for x in batch:
                v, n = np.unique(np.asarray(x, float), return_counts=True)
                t = n.sum()
                mean = (v * n).sum() / t
                out.append((min(len(v), 10_000), np.log2(t) - (n * np.log2(n)).sum() / t, np.sqrt(max((v * v * n).sum() / t - mean * mean, 0.0))))
            yield pd.DataFrame(out, columns=["colours", "entropy", "deviation"])

    rows = df.select(key, values.alias("_v")).where("size(_v) > 0")
    return rows.withColumn("_s", run(F.col("_v"))).select(key, "_s.*")
