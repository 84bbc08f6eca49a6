"""Checks of requests before any file is touched, plans from analyses, and the texts and records made of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.arguments import POLICIES
from .rules import container_error
from .scalars import aspect_ratio, case, human_size, target_bitrate, valid_component

#: Suffixes that can be compressed, those copied as they are without loss, and where a montage can go.
COMPRESSIBLE = [".jpg", ".jpeg", ".png", ".webp", ".avif", ".heic", ".heif", ".tiff", ".tif"]
COPIED = [".jpg", ".jpeg", ".webp", ".avif", ".heic", ".heif"]
LOSSLESS = [".png", ".tif", ".tiff"]
MONTAGES = [".png", ".jpg", ".jpeg", ".webp"]
PRESETS = ["lossless", "high", "medium", "low", "tiny"]
#: Defaults that automation can rely on.
DEFAULTS = {"compress_preset": "medium", "convert_quality": "high", "pdf_extract_dpi": "150", "pdf_merge_margin": "20", "strip_mode": "privacy", "watermark_font_size": "auto"}
#: Why a kind of picture gets its format, and what speaks for the format.
KIND_REASONS = {"photo": "照片类图片，有损压缩效果最佳", "screenshot": "截图/UI 类图片，无损压缩保持清晰", "graphic": "图形/图标类图片，颜色少适合无损", "text": "文字类图片，需要无损保持清晰"}
FORMAT_REASONS = {"WebP": "，WebP 兼容性好且压缩率高", "AVIF": "，AVIF 压缩率最高但兼容性稍差", "PNG": "，PNG 无损且兼容性最好", "JPEG": "，JPEG 兼容性最广"}
#: Codes of what a command line can get wrong.
USAGE_CODES = {"NoSuchOption": "invalid_option", "MissingParameter": "missing_parameter", "BadParameter": "invalid_value", "UsageError": "usage_error"}
LEAST_BITRATE = 8_000


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


# -- paths ---------------------------------------------------------------------


def absolute(path: Column, base: str = "/") -> Column:
    """A path without '.', '..' and repeated slashes, relative ones below ``base``; links aren't followed."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    steps = F.filter(F.split(whole, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda out, s: F.when(s != "..", F.concat(out, F.array(s))).otherwise(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def below(path: Column, root: Column) -> Column:
    """Whether an absolute path is the root or inside it."""
    return (path == root) | F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def nested_root(output_root: Column, sources: list[str]) -> Column:
    """The output root if it lies strictly inside one of the source folders, else null."""
    root = absolute(output_root)
    inside = F.lit(False)
    for s in sources:
        inside = inside | ((root != s) & below(root, F.lit(s)))
    return F.when(~_empty(output_root) & inside, root)


def collision_key(path: Column, folded: bool = False) -> Column:
    """What two outputs must not share; ``folded`` for file systems that ignore case."""
    return F.lower(absolute(path)) if folded else absolute(path)


def affix_error(text: Column) -> Column:
    """'' for a prefix or suffix that may be part of a file's name; an empty one may."""
    return F.when(_empty(text) | valid_component(text), "").otherwise("invalid_filename_component")


def planned_error(root: Column, relative: Column) -> Column:
    """'' if a relative path stays below its root and ends in a plain name."""
    name = F.regexp_extract(relative, "([^/]*)/*$", 1)
    return (
        F.when(F.startswith(relative, F.lit("/")), "output_boundary").when(~valid_component(name), "invalid_filename_component")
        .when(~below(absolute(F.concat(root, F.lit("/"), relative)), absolute(root)), "output_boundary").otherwise("")
    )


def absolute_argument(path: Column) -> Column:
    """A path that can't be taken for an option; null if it still could."""
    out = absolute(path)
    return F.when(~F.startswith(out, F.lit("-")), out)


def aggregate_aliases(inputs: Column, output: Column) -> Column:
    """Whether an output made of several inputs is one of them."""
    return F.exists(inputs, lambda x: collision_key(x) == collision_key(output))


# -- requests ------------------------------------------------------------------


def minimum_size(text: Column, parsed: Column) -> Column:
    """(bytes, error) of an optional least file size; no text means none."""
    good = text.isNull() | parsed.isNotNull()
    return F.struct(F.when(good, F.coalesce(parsed, F.lit(0).cast("long"))).alias("bytes"), F.when(good, "").otherwise("invalid_min_file_size").alias("error"))


def still_error(frames: Column, pixels: Column, limit: int = 120_000_000) -> Column:
    return F.when(pixels > limit, "image_too_large").when(frames > 1, "animated_input_not_supported").otherwise("")


def copied_losslessly(suffix: Column, preset: Column, quality: Column, target: Column, longest: Column) -> Column:
    """Whether a lossless request is met by the source's own bytes."""
    return (preset == "lossless") & quality.isNull() & target.isNull() & longest.isNull() & suffix.isin(COPIED)


def already_fits(size: Column, w: Column, h: Column, target: Column, longest: Column) -> Column:
    return F.coalesce((size <= target) & (longest.isNull() | (F.greatest(w, h) <= longest)), F.lit(False))


def compress_error(suffix: Column, there: Column, preset: Column, quality: Column, target: Column, longest: Column, overwrite: bool = False) -> Column:
    taken = F.lit(False) if overwrite else there
    return (
        F.when(taken, "output_exists").when(~suffix.isin(COMPRESSIBLE), F.concat(F.lit("unsupported_input_format:"), suffix)).when(~preset.isin(PRESETS), F.concat(F.lit("unsupported_compress_preset:"), preset))
        .when(longest <= 0, "max_size_must_be_positive").when(~quality.between(1, 100), "quality_must_be_between_1_and_100")
        .when(quality.isNotNull() & target.isNotNull(), "quality_and_target_size_are_mutually_exclusive").otherwise("")
    )


def crop_error(box: Column, parsed: Column, aspect: Column, trim: Column) -> Column:
    """A crop has exactly one of a box, an aspect and trimming; ``parsed`` is the box's (left, top, right, bottom) or null."""
    asked = box.isNotNull().cast("int") + aspect.isNotNull().cast("int") + F.coalesce(trim, F.lit(False)).cast("int")
    at = lambda i: F.get(parsed, i)
    whole = parsed.isNotNull() & (at(0) >= 0) & (at(1) >= 0) & (at(2) > at(0)) & (at(3) > at(1))
    return (
        F.when(asked != 1, "select_exactly_one_mode").when(box.isNotNull() & ~F.coalesce(whole, F.lit(False)), "invalid_crop_box")
        .when(aspect.isNotNull() & aspect_ratio(aspect)["w"].isNull(), "invalid_aspect_ratio").otherwise("")
    )


def montage_error(suffix: Column, cols: Column, gap: Column, border: Column, cell_w: Column, cell_h: Column) -> Column:
    return (
        F.when(~suffix.isin(MONTAGES), F.concat(F.lit("unsupported_output_format: "), F.when(suffix == "", "<none>").otherwise(suffix)))
        .when((cols <= 0) | (gap < 0) | (border < 0), "invalid_montage_layout").when(cell_w <= 0, "invalid_cell_width").when(cell_h <= 0, "invalid_cell_height").otherwise("")
    )


def target_error(policy: Column, source_there: Column, output_there: Column, target: Column, overwrite: bool = False) -> Column:
    taken = F.lit(False) if overwrite else output_there
    return (
        F.when(~policy.isin(list(POLICIES)), F.concat(F.lit("unsupported_audio_policy:"), policy)).when(~source_there, "input_not_found").when(taken, "output_exists")
        .when(target <= 0, "target_size_must_be_positive").otherwise("")
    )


def concat_error(paths: Column, output: Column, all_there: Column, output_there: Column, overwrite: bool = False, reencode: bool = False) -> Column:
    """The first fault of a request to join clips; one that encodes them anew needs a container for that."""
    container = container_error(F.regexp_extract(output, "(\\.[^./]*)?$", 1), F.lit("h264"))
    taken = F.lit(False) if overwrite else output_there
    return (
        F.when(F.size(paths) < 2, "concat_requires_two_inputs").when(aggregate_aliases(paths, output), "output_collision").when(~all_there, "input_not_found")
        .when(taken, "output_exists").otherwise(container if reencode else F.lit(""))
    )


def policy_bitrate(size: Column, duration: Column, has_audio: Column, policy: Column) -> Column:
    """The video bitrate for a size; a copied track is reckoned like a compatible one."""
    return F.when(policy == "compact", target_bitrate(size, duration, has_audio, POLICIES["compact"])).otherwise(target_bitrate(size, duration, has_audio, POLICIES["compatible"]))


def retry_bitrate(bps: Column, target: Column, actual: Column) -> Column:
    """The second attempt's bitrate after the first made ``actual`` bytes; null if that fits."""
    return F.when(actual > target, F.greatest(F.lit(LEAST_BITRATE).cast("long"), F.floor(bps * target / actual * 0.95).cast("long")))


def replaceable(smask: Column, mask: Column, stencil: Column, odd_decode: Column) -> Column:
    """Whether an embedded picture can be replaced: no masks, no stencil, the usual decoding."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (F.coalesce(smask, F.lit(0)) == 0) & no(mask) & no(stencil) & no(odd_decode)


def placement_scale(w: Column, h: Column, dpi: Column, placements: Column) -> Column:
    """What an embedded picture may be scaled to: the largest need of its placements (width, height in points), at most 1."""
    real = F.filter(placements, lambda p: (p["width"] > 0) & (p["height"] > 0))
    need = F.transform(real, lambda p: F.least(F.lit(1.0), dpi / F.greatest(w / (p["width"] / 72), h / (p["height"] / 72))))
    asked = F.coalesce((dpi > 0) & (w > 0) & (h > 0), F.lit(False))
    return F.when(asked, F.coalesce(F.array_max(need), F.lit(1.0))).otherwise(1.0)


# -- plans and texts -------------------------------------------------------------


def _plan(command: str, **arguments: str) -> Column:
    given = F.create_map(*(F.lit(x) for pair in arguments.items() for x in pair)) if arguments else F.from_json(F.lit("{}"), "map<string,string>")
    return F.struct(F.lit(command).alias("command"), given.alias("arguments"))


def plan_for(input_format: Column, recommended: Column) -> Column:
    """(command, arguments) that carries out a recommendation: converting, or compressing what has the format already."""
    own = F.regexp_replace(F.lower(input_format), "^[.]+", "")
    starts = lambda name: F.startswith(recommended, F.lit(name))
    return (
        F.when(recommended == "PNG", F.when(own == "png", _plan("compress", preset="lossless")).otherwise(_plan("convert", to="png", quality="web")))
        .when(starts("WebP"), F.when(own == "webp", _plan("compress", quality="90")).otherwise(_plan("convert", to="webp", quality="high")))
        .when(starts("AVIF"), F.when(own == "avif", _plan("compress", quality="90")).otherwise(_plan("convert", to="avif", quality="high")))
        .when(starts("JPEG"), F.when(own.isin("jpg", "jpeg"), _plan("compress", quality="95")).otherwise(_plan("convert", to="jpg", quality="high")))
        .otherwise(_plan("convert", to="png", quality="web"))
    )


def animation_plan(input_format: Column) -> Column:
    return F.when(F.lower(input_format) == "webp", _plan("keep")).otherwise(_plan("convert", to="webp", quality="high"))


def video_plan(action: Column, codec: Column) -> Column:
    """(command, arguments) of a video's recommendation."""
    arguments = F.when(action == "video.compress", F.create_map(F.lit("preset"), F.lit("web"), F.lit("codec"), codec)).when(action == "video.convert", F.create_map(F.lit("to"), F.lit("mp4"), F.lit("codec"), codec))
    return F.struct(action.alias("command"), F.coalesce(arguments, F.from_json(F.lit("{}"), "map<string,string>")).alias("arguments"))


def reason(kind: Column, recommended: Column) -> Column:
    """Why a picture of a kind gets the format."""
    ends = F.lit("")
    for name, text in reversed(FORMAT_REASONS.items()):
        ends = F.when(F.contains(recommended, F.lit(name)), text).otherwise(ends)
    return F.concat(F.coalesce(case(kind, KIND_REASONS), F.lit("")), ends)


def plan_text(command: Column, arguments: Column) -> Column:
    """A plan as one types it; '-' without a command."""
    arg = lambda k, default: F.coalesce(F.try_element_at(arguments, F.lit(k)), F.lit(default))
    codec = F.try_element_at(arguments, F.lit("codec"))
    return (
        F.when(_empty(command) | arguments.isNull(), "-").when(command == "keep", "保持现状")
        .when(command == "video.compress", F.concat(F.lit("video compress -p "), arg("preset", "web"), F.lit(" --codec "), arg("codec", "h264")))
        .when(command == "video.convert", F.concat(F.lit("video convert -t "), arg("to", "mp4"), F.when(_empty(codec), "").otherwise(F.concat(F.lit(" --codec "), codec))))
        .when((command == "compress") & F.map_contains_key(arguments, "quality"), F.concat(F.lit("compress --quality "), arg("quality", "")))
        .when(command == "compress", F.concat(F.lit("compress -p "), arg("preset", "medium")))
        .otherwise(F.concat(F.lit("convert -t "), arg("to", "png"), F.lit(" -q "), arg("quality", "high")))
    )


def ratio_text(total_in: Column, total_out: Column) -> Column:
    """How large the output is against the input; empty where one of them is nothing."""
    share = F.format_string("%.1f%%", total_out / total_in * 100)
    saved = total_in - total_out
    line = lambda colour, word, n: F.concat(F.lit(f"  体积比: [{colour}]"), share, F.lit(f"[/{colour}]（{word} "), human_size(n), F.lit("）"))
    return F.when((total_in <= 0) | (total_out <= 0), "").when(saved >= 0, line("green", "节省", saved)).otherwise(line("yellow", "增加", -saved))


def estimated_size(encoded: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.bround(encoded * scale).cast("long"))


def video_estimates(codec: Column, label: Column, estimated: Column, input_bytes: Column) -> Column:
    """The estimates of a video's record: one, or none without an estimate; the ratio to four places."""
    ratio = F.when(input_bytes > 0, F.bround(estimated / input_bytes, 4)).otherwise(0.0)
    one = F.struct(codec.alias("format"), label.alias("label"), estimated.alias("estimated_bytes"), ratio.alias("compression_ratio"), F.lit(False).alias("lossless"), F.lit(True).alias("recommended"))
    return F.when(estimated > 0, F.array(one)).otherwise(F.filter(F.array(one), lambda _: F.lit(False)))


def usage_code(kind: Column) -> Column:
    return F.coalesce(case(kind, USAGE_CODES), F.lit("cli_error"))


def command_id(arguments: Column) -> Column:
    """The command that a command line means: two words for groups of commands, 'cli' without any."""
    words = F.filter(arguments, lambda a: ~F.startswith(a, F.lit("-")))
    first, second = F.get(words, 0), F.get(words, 1)
    return F.when(first.isNull(), "cli").when(first.isin("pdf", "watermark", "video") & second.isNotNull(), F.concat(first, F.lit("."), second)).otherwise(first)
