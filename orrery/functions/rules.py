"""More column rules: media checks, validation of requests, layout arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.arguments import CODECS, CONTAINERS
from .scalars import INFINITY, case


def probe_number(text: Column) -> Column:
    """A number from probe text; 0 if it is none, negative or not finite."""
    v = text.try_cast("double")
    return F.coalesce(F.when((v >= 0) & (v < INFINITY), v), F.lit(0.0))


def probe_integer(text: Column) -> Column:
    return F.floor(probe_number(text)).cast("long")


def resize_request(text: Column) -> Column:
    """(kind, a, b) of 'N%' or 'WxH'; null if it is neither."""
    s = F.trim(text)
    share = F.regexp_extract(s, "^([0-9]+(?:\\.[0-9]+)?)%$", 1).try_cast("double")
    w, h = (F.regexp_extract(F.lower(s), "^([0-9]{1,9})x([0-9]{1,9})$", i).try_cast("double") for i in (1, 2))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    return F.when(share > 0, row("percent", share, F.lit(0.0))).when((w > 0) & (h > 0), row("size", w, h))


def fitted(w: Column, h: Column, most: Column) -> Column:
    """(width, height) with the longer side at most ``most``; never enlarged, never 0."""
    scale = F.least(F.lit(1.0), most / F.greatest(w, h))
    side = lambda n: F.greatest(F.lit(1), F.bround(n * scale).cast("int"))
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def signal_to_noise(source_db: Column, difference_db: Column) -> Column:
    """dB of a signal over its difference: infinite without difference, minus infinite without signal."""
    silent, same = source_db == -INFINITY, difference_db == -INFINITY
    return F.when(same, F.lit(INFINITY)).when(silent, F.lit(-INFINITY)).otherwise(source_db - difference_db)


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero as SQL's ``round`` of doubles has it: scaled, rounded and scaled back in double precision.

    Spark's own rounds the shortest decimal text of a double, which is another
    double where the scaled value has no room for its last digit.
    """
    scaled = x * 10.0**digits
    size = F.abs(scaled)
    near = F.rint(size)
    out = F.signum(scaled) * (near + F.when(size - near == 0.5, 1.0).otherwise(0.0)) / 10.0**digits
    return F.when(F.abs(out) < INFINITY, out).otherwise(x)


def hardware_quality(crf: Column) -> Column:
    """A hardware encoder's 1 to 100 for a constant rate factor."""
    return F.greatest(F.lit(1), F.least(F.lit(100), F.bround((51 - crf) * 2.0).cast("int")))


def loop_count(loop: Column) -> Column:
    return F.coalesce(loop, F.lit(1))


def container_error(container: Column, codec: Column) -> Column:
    """'' if the container can hold the codec; error codes for what is unknown or can't."""
    box = F.regexp_replace(F.lower(container), "^[.]+", "")
    held = case(box, {k: F.array(*(F.lit(c) for c in v)) for k, (_, v) in CONTAINERS.items()})
    code = lambda name, *of: F.concat(F.lit(name), *(x for c in of for x in (F.lit(":"), c)))
    return (
        F.when(held.isNull(), code("unsupported_target_container", box)).when(~codec.isin(list(CODECS)), code("unsupported_video_codec", codec))
        .when(F.array_contains(held, codec), "").otherwise(code("unsupported_codec_for_container", codec, box))
    )


def worker_bound(cpus: Column, tasks: Column, requested: Column, pixels: Column, memory: int = 1 << 30) -> Column:
    """Processes for a batch: at most 8, as many as decoded pictures fit in memory; one if no picture's ``pixels`` are known (null), none without tasks."""
    fit = F.when(pixels > 0, F.floor(F.lit(memory) / (pixels * 16))).otherwise(8)
    n = F.least(cpus, tasks, F.lit(8), F.when(requested > 0, requested).otherwise(8), fit)
    return F.when(tasks <= 0, 0).when(pixels.isNull(), 1).otherwise(F.greatest(F.lit(1), n)).cast("int")


def page_fit(w: Column, h: Column, page_w: float, page_h: float, margin: float) -> Column:
    """(x, y, width, height) of a picture centred on a page within its margin."""
    scale = F.least((page_w - 2 * margin) / w, (page_h - 2 * margin) / h)
    return F.struct(*(F.round(c, 4).alias(k) for k, c in {"x": (page_w - w * scale) / 2, "y": (page_h - h * scale) / 2, "width": w * scale, "height": h * scale}.items()))


def gate_request_error(min_ssim: Column, min_psnr: Column, most_bytes: Column, same_media: Column, found: Column | None = None) -> Column:
    """Why a comparison is rejected before it is made; '' if it isn't.  ``min_psnr`` and ``most_bytes`` may be null; ``found``: both files are there."""
    bad_psnr = F.isnan(min_psnr) | (min_psnr < 0) | (min_psnr == INFINITY)
    there = F.lit(True) if found is None else F.coalesce(found, F.lit(False))
    return (
        F.when(F.isnan(min_ssim) | ~min_ssim.between(0, 1) | F.coalesce(bad_psnr, F.lit(False)), "invalid_quality_threshold").when(most_bytes <= 0, "invalid_max_size")
        .when(~there, "input_not_found").when(~same_media, "unsupported_media_pair").otherwise("")
    )


#: What each strip mode removes (everything, gps, device, personal, time).
STRIP_MODES = {"privacy": (0, 1, 1, 1, 0), "all": (1, 0, 0, 0, 0), "gps": (0, 1, 0, 0, 0), "device": (0, 0, 1, 0, 0), "personal": (0, 0, 0, 1, 0), "time": (0, 0, 0, 0, 1)}


def strip_flags(mode: Column) -> Column:
    """The five flags of a mode, in any case and with spaces around; null for an unknown one."""
    return case(F.lower(F.trim(mode)), {k: F.array(*(F.lit(bool(x)) for x in v)) for k, v in STRIP_MODES.items()})


def metric_value(text: Column) -> Column:
    """The overall value in a quality filter's log line: 'All:x' or 'average:x', which may be inf."""
    found = F.regexp_extract(text, "(?:All|average):\\s*([0-9.]+|inf)", 1)
    return F.when(found == "inf", F.lit(INFINITY)).otherwise(found.try_cast("double"))
