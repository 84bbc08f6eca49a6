"""Column builders: parsers, formatters and decision rules.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def _num(c: Column) -> Column:
    """A finite double from text, else null."""
    v = c.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < INFINITY), v)


def parse_size(text: Column) -> Column:
    """Bytes of '500KB', '2.5MB', '10': 1024-based, truncated; null unless finite, positive and at most 2**60."""
    s = F.upper(F.trim(text))
    unit = F.regexp_extract(s, "(KB|MB|GB|B)$", 1)
    number = _num(F.trim(F.regexp_replace(s, "(KB|MB|GB|B)$", "")))
    value = number * F.when(unit == "KB", 1024.0).when(unit == "MB", 1048576.0).when(unit == "GB", 1073741824.0).otherwise(1.0)
    return F.when((value > 0) & (value <= float(1 << 60)), F.floor(value).cast("long"))


def human_size(n: Column) -> Column:
    """'1.2 KB': divided by 1024 up to TB; one digit, half to even."""
    value, out = n.cast("double"), None
    for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        text = F.format_string(f"%.1f {unit}", F.bround(value / float(1024**i), 1))
        test = value < float(1024 ** (i + 1))
        out = F.when(test, text) if out is None else out.when(test, text) if unit != "TB" else out.otherwise(text)
    return out


def timecode(text: Column) -> Column:
    """Seconds of up to three colon-separated fields, folded by 60; null unless each is finite and not negative."""
    parts = F.transform(F.split(text, ":"), lambda p: _num(F.trim(p)))
    good = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.isNotNull() & (p >= 0))
    return F.when(good, F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p))


def thumbnail_time(text: Column, duration: Column) -> Column:
    """A share 'P%' of the duration (0 to 100), else a timecode."""
    share = _num(F.trim(F.regexp_replace(F.trim(text), "%$", "")))
    return F.when(F.trim(text).endswith("%"), F.when(share.between(0, 100), share / 100 * duration)).otherwise(timecode(text))


def frame_rate(text: Column) -> Column:
    """Frames a second from 'n/d' or a plain number; 0 for anything unusable."""
    parts = F.split(text, "/")
    n, d = _num(F.get(parts, 0)), _num(F.get(parts, 1))
    rate = F.when(F.size(parts) == 1, n).when(F.size(parts) == 2, F.try_divide(n, d))
    return F.when(rate.isNotNull() & (rate >= 0) & (rate < INFINITY), rate).otherwise(0.0)


def page_range(text: Column, total: Column) -> Column:
    """Sorted distinct pages, from 0, of '1-5,8' (from 1, inclusive); null if any part is bad.  No text at all means all pages."""
    pair = lambda p: F.when(p.rlike("^\\s*[0-9]{1,9}\\s*(-\\s*[0-9]{1,9}\\s*)?$"), F.transform(F.split(p, "-"), lambda x: F.trim(x).cast("int")))
    parts = F.transform(F.split(text, ","), pair)
    first, last = (lambda p: F.get(p, 0)), (lambda p: F.element_at(p, -1))
    good = F.forall(parts, lambda p: p.isNotNull() & (first(p) >= 1) & (first(p) <= last(p)) & (last(p) <= total))
    safe = F.filter(parts, lambda p: p.isNotNull() & (first(p) <= last(p)) & (last(p) <= total) & (first(p) >= 1))
    pages = F.flatten(F.transform(safe, lambda p: F.sequence(first(p) - 1, last(p) - 1)))
    every = F.when(total > 0, F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNull(), every).when(good, F.array_sort(F.array_distinct(pages)))


def dimensions(text: Column) -> Column:
    """(width, height) of 'WxH'; null unless both are positive integers."""
    ok = F.lower(F.trim(text)).rlike("^[0-9]{1,9}x[0-9]{1,9}$")
    parts = F.split(F.lower(F.trim(text)), "x")
    w, h = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    return F.when(ok & (w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))


def aspect_ratio(text: Column) -> Column:
    """(w, h) of 'W:H'; null unless both are positive integers."""
    parts = F.split(text, ":")
    w, h = (F.trim(F.get(parts, i)).try_cast("int") for i in (0, 1))
    return F.when((F.size(parts) == 2) & (w > 0) & (h > 0), F.struct(w.alias("w"), h.alias("h")))


def crop_box(text: Column) -> Column:
    """(left, top, right, bottom) of four integers."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("int"))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull()), F.struct(*(F.get(parts, i).alias(k) for i, k in enumerate(["left", "top", "right", "bottom"]))))


#: Names a colour may have.
COLOURS = {"white": (255, 255, 255), "black": (0, 0, 0), "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "gray": (128, 128, 128), "grey": (128, 128, 128)}


def colour(text: Column) -> Column:
    """[r, g, b, a] of a name, #RRGGBB, #RRGGBBAA or 'R,G,B[,A]'; null if it is none."""
    s = F.lower(F.trim(text))
    hexes = F.regexp_replace(s, "^#", "")
    byte = lambda i: F.conv(F.substring(hexes, 2 * i + 1, 2), 16, 10).cast("int")
    parts = F.transform(F.split(s, ","), lambda p: F.trim(p).try_cast("int"))
    named = None
    for name, rgb in COLOURS.items():
        value = F.array(*(F.lit(v) for v in (*rgb, 255)))
        named = F.when(s == name, value) if named is None else named.when(s == name, value)
    by_number = F.forall(parts, lambda p: p.isNotNull() & p.between(0, 255))
    return (
        named.when(s.rlike("^#[0-9a-f]{6}$"), F.array(byte(0), byte(1), byte(2), F.lit(255)))
        .when(s.rlike("^#[0-9a-f]{8}$"), F.array(byte(0), byte(1), byte(2), byte(3)))
        .when((F.size(parts) == 3) & by_number, F.concat(parts, F.array(F.lit(255))))
        .when((F.size(parts) == 4) & by_number, parts)
    )


def hash_hex(h: Column, digits: int = 16) -> Column:
    return F.lpad(F.lower(F.hex(h)), digits, "0")


def shortened(text: Column, most: int = 30) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def preview(items: Column, limit: int = 18) -> Column:
    """The first items and how many more there are."""
    more = F.size(items) - limit
    return F.concat(F.array_join(F.slice(items, 1, limit), ", "), F.when(more > 0, F.format_string(" (+%d)", more)).otherwise(""))


#: Device names that can't be file names.
RESERVED = ["con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))]


def valid_component(name: Column) -> Column:
    """Whether a text can be a file's name: no path or control characters, no trailing space or dot, no device name."""
    bad = name.isin("", ".", "..") | name.rlike('[<>:"/\\\\|?*\\x00-\\x1f]') | name.rlike("[ .]$") | F.lower(F.substring_index(name, ".", 1)).isin(RESERVED)
    return F.coalesce(~bad, F.lit(False))


def extension(name: Column) -> Column:
    """Lower-cased suffix with its dot; empty without one."""
    return F.lower(F.regexp_extract(name, "[^/.](\\.[^./]+)$", 1))


def normal_extension(text: Column) -> Column:
    return F.concat(F.lit("."), F.regexp_replace(F.lower(text), "^\\.+", ""))


#: Suffixes by kind of media.
IMAGES = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".tif", ".gif", ".heic", ".heif", ".avif", ".ico", ".ppm", ".tga"]
VIDEOS = [".mp4", ".mov", ".mkv", ".webm", ".avi", ".m4v", ".wmv", ".flv", ".mpg", ".mpeg", ".3gp", ".ts"]


def media_type(path: Column) -> Column:
    e = extension(path)
    return F.when(e == ".pdf", "pdf").when(e.isin(VIDEOS), "video").when(e.isin(IMAGES), "image").otherwise("")


def has_transparency(mode: Column, key: Column) -> Column:
    return mode.isin("RGBA", "RGBa", "LA", "La", "PA") | ((mode == "P") & F.coalesce(key, F.lit(False)))


# -- metrics -----------------------------------------------------------------


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def psnr(mse: Column) -> Column:
    return F.when(mse == 0, F.lit(INFINITY)).otherwise(10 * F.log10(65025.0 / mse))


def ssim(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column, cov: Column) -> Column:
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return ((2 * mean_a * mean_b + c1) * (2 * cov + c2)) / ((mean_a * mean_a + mean_b * mean_b + c1) * (var_a + var_b + c2))


def quality_rating(ssim_: Column, psnr_: Column, mse: Column) -> Column:
    return (
        F.when(mse == 0, "完美").when((ssim_ >= 0.95) & (psnr_ >= 40), "优秀").when((ssim_ >= 0.90) & (psnr_ >= 35), "良好")
        .when((ssim_ >= 0.80) & (psnr_ >= 30), "一般").when(ssim_ >= 0.60, "较差").otherwise("差")
    )


def within_pixels(pixels: Column, limit: int = 120_000_000) -> Column:
    """Error code of a picture beyond the pixel budget; empty within it.  0 switches the budget off."""
    return F.when((F.lit(limit) == 0) | (pixels <= limit), "").otherwise(F.concat(F.lit("image_too_large:"), pixels.cast("string"), F.lit(f">{limit}")))


def aspect_differs(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float = 0.01) -> Column:
    a, b = w1 / h1, w2 / h2
    return F.abs(a - b) / a > tolerance


def duration_matches(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(0.25), a * 0.005)


# -- media decisions -----------------------------------------------------------

#: Bits a pixel above which a codec's video is worth recoding, and those aimed at.
WORTHWHILE = {"h264": 0.15, "h265": 0.11, "vp9": 0.11, "av1": 0.09}
TARGET = {"h264": 0.10, "h265": 0.07, "vp9": 0.07, "av1": 0.06}
INTERMEDIATE = 0.5
MODERN_CONTAINERS = ["mp4", "mov", "webm", "mkv"]


def case(key: Column, values: dict, default=None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default) if default is not None else out


def pixel_rate(w: Column, h: Column, fps: Column) -> Column:
    return F.when((w > 0) & (h > 0) & (fps > 0), w * h * fps).otherwise(0.0)


def bits_per_pixel(bit_rate: Column, rate: Column) -> Column:
    return F.when((bit_rate > 0) & (rate > 0), F.bround(bit_rate / rate, 4))


def estimated_video_bytes(codec: Column, rate: Column, duration: Column, has_audio: Column) -> Column:
    bits = case(codec, TARGET, 0.10) * rate + F.when(has_audio, 128000.0).otherwise(0.0)
    return F.floor(bits * duration / 8).cast("long")


def target_bitrate(size: Column, duration: Column, has_audio: Column, audio_bps: int = 192_000) -> Column:
    """Video bits a second that make a file of ``size`` bytes, with 2 % left for the container; 0 where there's no such rate."""
    bits = size * 8 / duration * 0.98 - F.when(has_audio, float(audio_bps)).otherwise(0.0)
    good = (duration >= 0.05) & (duration < INFINITY) & (size > 0)
    return F.coalesce(F.when(good, F.floor(F.least(F.greatest(bits, F.lit(0.0)), F.lit(2e9))).cast("long")), F.lit(0).cast("long"))


def video_action(codec: Column, container: Column, bpp: Column, legacy: list[str], family: dict[str, str]) -> Column:
    """(action, codec): what to do with a video, from its codec, container and bits a pixel."""
    row = lambda action, c: F.struct(F.lit(action).alias("action"), (c if isinstance(c, Column) else F.lit(c).cast("string")).alias("codec"))
    old = F.when(codec == "vp8", "vp9").otherwise("h264")
    modern = case(codec, family)
    keep = row("keep", None)
    return (
        F.when(codec.isin(legacy), F.when(container.isin(MODERN_CONTAINERS), row("video.compress", old)).otherwise(row("video.convert", old)))
        .when(modern.isNotNull(), F.when(bpp.isNotNull() & (bpp > case(modern, WORTHWHILE)), row("video.compress", modern)).otherwise(keep))
        .when(bpp > INTERMEDIATE, row("video.convert", F.lit("h264"))).otherwise(keep)
    )


def image_type(colours: Column, entropy: Column, deviation: Column) -> Column:
    return (
        F.when(colours < 50, "graphic").when((colours >= 128) & (entropy >= 7), "photo").when((colours < 256) & (deviation < 40), "screenshot")
        .when(deviation > 50, "photo").when(colours < 500, "graphic").otherwise("photo")
    )


def crop_to_aspect(w: Column, h: Column, rw: Column, rh: Column, gravity: Column) -> Column:
    """The largest box of a ratio in a picture, placed by gravity."""
    wide = w * rh > h * rw
    cw = F.when(wide, F.floor(h * rw / rh)).otherwise(w).cast("int")
    ch = F.when(wide, h).otherwise(F.floor(w * rh / rw)).cast("int")
    left = F.when(gravity.isin("left", "top-left", "bottom-left"), 0).when(gravity.isin("right", "top-right", "bottom-right"), w - cw).otherwise(F.floor((w - cw) / 2)).cast("int")
    top = F.when(gravity.isin("top", "top-left", "top-right"), 0).when(gravity.isin("bottom", "bottom-left", "bottom-right"), h - ch).otherwise(F.floor((h - ch) / 2)).cast("int")
    return F.struct(left.alias("left"), top.alias("top"), (left + cw).alias("right"), (top + ch).alias("bottom"))


def overlay_position(w: Column, h: Column, ow: Column, oh: Column, where: Column, margin: Column) -> Column:
    """Upper left corner of an overlay for one of nine anchors; any other is the lower right one.  It may lie outside a small picture."""
    near, far = 0.02, 0.98  # fixed values: an anchor's share of the free space, unless the margin is nearer to the middle
    anchor = F.when(where.isin([f"{v}-{s}" for v in ("top", "center", "bottom") for s in ("left", "center", "right") if (v, s) != ("center", "center")] + ["center"]), where).otherwise("bottom-right")

    def place(free: Column, low: Column, high: Column) -> Column:
        at = F.when(low, F.greatest(margin.cast("double"), near * free)).when(high, F.least((free - margin).cast("double"), far * free)).otherwise(0.5 * free)
        return at.cast("int")  # towards zero

    x = place(w - ow, anchor.endswith("left"), anchor.endswith("right"))
    y = place(h - oh, anchor.startswith("top"), anchor.startswith("bottom"))
    return F.struct(x.alias("x"), y.alias("y"))


def font_size(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(12), F.least(F.lit(256), F.bround(0.04 * F.least(w, h)).cast("int")))


def downsample(w: Column, h: Column, limit: int = 4_000_000) -> Column:
    """(width, height) within a number of pixels."""
    scale = F.sqrt(limit / (w * h))
    fit = w * h > limit
    return F.struct(F.when(fit, F.greatest(F.lit(1), F.floor(w * scale).cast("int"))).otherwise(w).alias("width"), F.when(fit, F.greatest(F.lit(1), F.floor(h * scale).cast("int"))).otherwise(h).alias("height"))
