"""Plan documents: JSON lists of steps, in any of four envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import STRIP_MODES, container_error
from ..functions.scalars import case
from .arguments import CODECS, CONTAINERS, POLICIES, PRESETS

STEP = "struct<input:string,input_path:string,command:string,arguments:map<string,string>,plan:struct<command:string,arguments:map<string,string>>>"


#: What a document may be: its members, if it's an object of steps, and those of a step that stands alone.
ENVELOPE = f"struct<listed:array<{STEP}>,results:array<{STEP}>,plans:array<{STEP}>,{STEP[len('struct<') : -1]}>"


def make_plan(input_: Column, command: Column, arguments: Column) -> Column:
    """JSON text of one step."""
    return F.to_json(F.struct(input_.alias("input"), command.alias("command"), arguments.alias("arguments")))


def read_plans(df: DataFrame, document: str) -> DataFrame:
    """One row a step of each JSON document: (..., step, input, command, arguments, error).

    Documents are a list of steps, {"results": [...]}, {"plans": [...]} or one
    step.  Only results with a plan object that names a command are steps; the
    input of any step may be called input_path.  What is none of these, and
    steps without input or command, get an error code.
    """
    text = F.trim(F.col(document))
    listed = text.startswith("[")
    # a list is the member of an object, too, so every document is parsed once and by one schema
    parsed = df.withColumn("_listed", listed).withColumn("_doc", F.from_json(F.when(listed, F.concat(F.lit('{"listed":'), text, F.lit("}"))).otherwise(text), ENVELOPE))
    source = lambda s: F.coalesce(F.nullif(s["input"], F.lit("")), s["input_path"]).alias("input")
    told = lambda s, of: F.struct(source(s), of["command"].alias("command"), of["arguments"].alias("arguments"), F.lit(False).alias("bad"))
    flat = lambda a: F.transform(a, lambda s: told(s, s))
    nested = lambda a: F.transform(F.filter(a, lambda s: F.coalesce(s["plan"]["command"], F.lit("")) != ""), lambda s: told(s, s["plan"]))
    doc = lambda name: F.col("_doc")[name]
    row = lambda bad: F.struct(F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("command"), F.lit(None).cast("map<string,string>").alias("arguments"), F.lit(bad).alias("bad"))
    # a list with something else than objects: as many steps, none of them valid
    others = F.transform(F.from_json(text, "array<string>"), lambda _: row(False))
    steps = (
        F.when(F.col("_listed"), F.coalesce(flat(doc("listed")), others)).when(doc("results").isNotNull(), nested(doc("results"))).when(doc("plans").isNotNull(), flat(doc("plans")))
        .when(doc("command").isNotNull(), F.array(told(F.col("_doc"), F.col("_doc"))))
    )
    rows = parsed.select(*df.columns, F.posexplode(F.coalesce(steps, F.array(row(True)))).alias("step", "_s")).select(*df.columns, "step", "_s.*")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    error = (
        F.when(F.col("bad"), "unrecognized_plan_document").when(F.col("input").isNull() & F.col("command").isNull() & F.col("arguments").isNull(), "invalid_plan_step")
        .when(empty("input"), "missing_input").when(empty("command"), "missing_command")
    )
    return rows.withColumn("error", error.otherwise("")).drop("bad")


#: What the arguments of the commands may be.
FORMATS = ["jpg", "jpeg", "png", "webp", "avif", "heic", "heif", "tiff", "tif", "bmp", "gif", "ico", "pdf", "tga"]
QUALITIES = ["max", "high", "medium", "low", "web"]
COLOUR_SPACES = ["preserve", "srgb"]
COMPRESS_PRESETS = ["lossless", "high", "medium", "low", "tiny"]
COMMANDS = ["convert", "compress", "strip", "keep", "video.convert", "video.compress"]


def validated(steps: DataFrame) -> DataFrame:
    """``steps`` with an error code where the command or an argument isn't allowed."""
    # arguments are looked up once, and the codes of each command are columns: no projection is a large one
    names = ["to", "format", "quality", "crf", "codec", "audio_policy", "preset", "mode", "color_space"]
    own = steps.withColumns({f"_{k}": F.try_element_at(F.col("arguments"), F.lit(k)) for k in names})
    given = lambda k, default="": F.coalesce(F.nullif(F.col(f"_{k}"), F.lit("")), F.lit(default))
    within = lambda c, low, high: F.coalesce(c.try_cast("int").between(low, high), F.lit(False))
    own = own.withColumns({
        "_target": F.lower(F.coalesce(F.nullif(F.col("_to"), F.lit("")), given("format"))), "_box": F.regexp_replace(F.lower(given("to")), "^[.]+", ""), "_sound": F.lower(given("audio_policy", "compatible")),
        "_how": F.lower(F.trim(F.col("_mode"))), "_size": given("preset", "web"), "_coder": given("codec", "h264"),
    })
    box, sound, how, size, coder = (F.col(c) for c in ("_box", "_sound", "_how", "_size", "_coder"))
    default = F.when(given("codec") == "", case(box, {k: name for k, (name, _) in CONTAINERS.items()})).otherwise(F.col("_codec"))
    own = own.withColumns({
        "_convert": F.when(F.col("_target") == "", "missing_target_format").when(~F.col("_target").isin(FORMATS), "unsupported_target_format").when(~given("quality", "high").isin(QUALITIES), "unsupported_quality").when(~given("color_space", "preserve").isin(COLOUR_SPACES), "unsupported_color_space"),
        "_compress": F.when(~given("preset", "medium").isin(COMPRESS_PRESETS), "unsupported_compress_preset").when(F.col("_quality").isNotNull() & ~within(F.col("_quality"), 1, 100), "invalid_quality"),
        "_strip": F.when(how.isNotNull() & ~how.isin(list(STRIP_MODES)), F.concat(F.lit("unsupported_strip_mode:"), F.when(how == "", "?").otherwise(how))),
        "_video": F.when(~sound.isin(list(POLICIES)), F.concat(F.lit("unsupported_audio_policy:"), sound)).when(F.col("_crf").isNotNull() & ~within(F.col("_crf"), 0, 63), "invalid_crf"), "_default": default,
    })
    own = own.withColumns({
        "_into": F.when(~box.isin(list(CONTAINERS)), F.concat(F.lit("unsupported_target_container:"), F.when(box == "", "?").otherwise(box))).otherwise(F.nullif(container_error(box, F.col("_default")), F.lit(""))),
        "_smaller": F.when(~size.isin(list(PRESETS)), F.concat(F.lit("unsupported_video_preset:"), size)).when(~coder.isin(list(CODECS)), F.concat(F.lit("unsupported_video_codec:"), coder)),
    })
    command = F.col("command")
    code = (
        F.when(F.col("error") != "", F.col("error")).when(~command.isin(COMMANDS), "unsupported_plan_command").when(command == "convert", F.col("_convert")).when(command == "compress", F.col("_compress"))
        .when(command == "strip", F.col("_strip")).when(command == "video.convert", F.coalesce("_video", "_into")).when(command == "video.compress", F.coalesce("_video", "_smaller"))
    )
    return own.withColumn("error", F.coalesce(code, F.lit(""))).select(*steps.columns)
