"""Verification of media with many frames or pages: from two tables of pictures to a gate.

Both sides are rows (media, position, picture).  Numbers of frames are
compared first, so the pixels of media that differ there are never moved;
frames meet by position, each pair is scored by itself, and a medium keeps its
worst frame and where that is.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import psnr
from .compare import picture_scores
from .pictures import lanczos, readable

WORKING_PIXELS = 4_000_000  # of a side that is compared; larger pictures are scaled to that
RATIO_OFF = 0.01
_PICTURE = ["data", "width", "height", "nChannels"]
SCORES = "mse double, ssim double, sampled boolean, same_size boolean, compatible boolean, error string"


def frame_scores(first, second, allow_resize: bool, to_first: bool) -> tuple:
    """A row of ``SCORES`` of two rows of the image source.

    Pictures of different sizes are compared only if they may be resized and
    their proportions differ by a hundredth at most: both at the smaller
    width and height, or the second at the first one's size.
    """
    try:
        a, b = readable(first), readable(second)
    except ValueError as error:
        return None, None, False, None, None, str(error)
    same = a.shape[:2] == b.shape[:2]
    if not same:
        p, q = a.shape[1] / a.shape[0], b.shape[1] / b.shape[0]
        fits = abs(p - q) / max(p, q) <= RATIO_OFF
        if not allow_resize or not fits:
            return None, None, False, False, fits, ""
        h, w = a.shape[:2] if to_first else (min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1]))
        a, b = (x if x.shape[:2] == (h, w) else lanczos(x, w, h) for x in (a, b))
    sampled = a.shape[0] * a.shape[1] > WORKING_PIXELS
    if sampled:
        scale = math.sqrt(WORKING_PIXELS / (a.shape[0] * a.shape[1]))
        a, b = (lanczos(x, max(1, int(x.shape[1] * scale)), max(1, int(x.shape[0] * scale))) for x in (a, b))
    mse, _, ssim = picture_scores(*((x.tobytes(), x.shape[1], x.shape[0], x.shape[2]) for x in (a, b)))
    return mse, ssim, sampled, same, True, ""


def _counted(side: DataFrame, media: str, name: str) -> DataFrame:
    error = F.max(F.when(F.col("error") != "", F.col("error"))) if "error" in side.columns else F.lit(None).cast("string")
    loop = F.max("loop") if "loop" in side.columns else F.lit(None).cast("int")
    return side.groupBy(F.col(media).alias("media")).agg(F.count("*").alias(f"{name}_frames"), loop.alias(f"{name}_loop"), error.alias(f"{name}_error"))


def verified(source: DataFrame, candidate: DataFrame, media: str = "origin", position: str = "frame", pages: bool = False, allow_resize: bool = False, min_ssim: float = 0.99, min_psnr: float | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """(media, checks, source_frames, candidate_frames, ssim, psnr, worst_position, sampled, passed, error), a row for each medium of either side.

    Sides have (media, position, width, height, nChannels, data), and may have
    ``duration_ms``, ``loop`` and ``error``; (media, position) is a key.
    ``checks`` has ``frame_count`` and ``dimensions`` (``page_count`` and
    ``page_geometry`` of ``pages``), and of animations ``loop`` (none is one)
    and ``timing``.  ssim and psnr are those of the worst frame of each,
    ``worst_position`` the first with the least ssim; null if no frames could
    be compared, as when their numbers differ.  A medium passes if all checks
    do and its worst frame reaches the thresholds; else the error is
    ``quality_gate_failed``.  A medium of one side only has ``input_not_found``,
    one with frames that can't be read ``verification_failed``.
    """
    invalid = min_psnr is not None and (not math.isfinite(min_psnr) or min_psnr < 0)
    if not 0 <= min_ssim <= 1 or invalid:
        raise ValueError("invalid_quality_threshold")
    counted = _counted(source, media, "source").join(_counted(candidate, media, "candidate"), "media", "full")
    equal = F.col("source_frames") == F.col("candidate_frames")
    broken = F.coalesce("source_error", "candidate_error")
    worth = counted.where(equal & broken.isNull()).select("media")
    pick = lambda side, name: side.select(F.col(media).alias("media"), F.col(position).alias("position"), F.struct(*_PICTURE).alias(name), (F.col("duration_ms") if "duration_ms" in side.columns else F.lit(None).cast("int")).alias(f"{name}_ms")).join(worth, "media", "left_semi")
    pairs = pick(source, "a").join(pick(candidate, "b"), ["media", "position"], "full")

    @F.pandas_udf(SCORES)
    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = [frame_scores(p, q, allow_resize, pages) for p, q in zip(x.itertuples(index=False), y.itertuples(index=False), strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCORES.split(", ")])

    whole = lambda c: F.struct(*(F.col(f"{c}.{f}").alias(f) for f in _PICTURE))
    scored = pairs.select("media", "position", F.col("a_ms").eqNullSafe(F.col("b_ms")).alias("timed"), (F.col("a").isNull() | F.col("b").isNull()).alias("alone"), score(whole("a"), whole("b")).alias("s"))
    worst = scored.groupBy("media").agg(
        F.min("s.ssim").alias("ssim"), F.min(psnr(F.col("s.mse"))).alias("psnr"), F.min_by("position", F.struct(F.col("s.ssim").isNull(), F.col("s.ssim"), "position")).alias("worst_position"), F.bool_or("s.sampled").alias("sampled"),
        F.bool_and("timed").alias("timed"), F.bool_and("s.same_size").alias("same_size"), F.bool_and("s.compatible").alias("compatible"), F.max(F.when(F.col("alone"), "frame_missing").when(F.col("s.error") != "", F.col("s.error"))).alias("frame_error"),
    )
    out = counted.join(worst, "media", "left")
    missing = F.col("source_frames").isNull() | F.col("candidate_frames").isNull()
    failed = F.coalesce(broken, F.col("frame_error"))
    animated = ~F.lit(pages) & ((F.col("source_frames") > 1) | (F.col("candidate_frames") > 1))
    sizes = F.col("same_size") | F.lit(allow_resize) & F.col("compatible")
    named = [
        (F.lit(True), "page_count" if pages else "frame_count", equal), (animated, "loop", F.coalesce("source_loop", F.lit(1)) == F.coalesce("candidate_loop", F.lit(1))), (equal & ~F.lit(pages), "timing", F.col("timed")),
        (equal, "page_geometry" if pages else "dimensions", sizes), *((F.lit(True), k, v) for k, v in (more or {}).items()),
    ]
    entries = F.filter(F.array(*(F.when(when, F.struct(F.lit(k).alias("key"), F.coalesce(v, F.lit(False)).alias("value"))) for when, k, v in named)), lambda e: e.isNotNull())
    out = out.withColumn("checks", F.when(~missing & failed.isNull(), F.map_from_entries(entries)))
    good = F.forall(F.map_values("checks"), lambda v: v) & F.coalesce(F.col("ssim") >= min_ssim, F.lit(False))
    if min_psnr is not None:
        good &= F.coalesce(F.col("psnr") >= min_psnr, F.lit(False))
    good = F.coalesce(good, F.lit(False))
    error = F.when(missing, "input_not_found").when(failed.isNotNull(), "verification_failed").when(good, "").otherwise("quality_gate_failed")
    position_ = F.when(F.col("ssim").isNotNull(), F.col("worst_position"))
    return out.select(F.col("media").alias(media), "checks", "source_frames", "candidate_frames", "ssim", "psnr", position_.alias("worst_position"), F.coalesce("sampled", F.lit(False)).alias("sampled"), good.alias("passed"), error.alias("error"))
