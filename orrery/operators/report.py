"""Report payloads: envelopes, failures, exit codes and the catalogue of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.1"


def envelope(command: str, ok: Column, **fields: Column) -> Column:
    """JSON text of a payload; infinite and undefined numbers are null, nulls stay."""
    head = {"schema_version": F.lit(SCHEMA_VERSION), "command": F.lit(command), "ok": ok}
    return F.to_json(F.struct(*(c.alias(k) for k, c in (head | fields).items())), {"ignoreNullFields": "false"})


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def exit_code(rejected: Column, ok: Column) -> Column:
    """2 for a request that was turned down, 1 for failures, else 0."""
    return F.when(rejected, 2).when(~ok, 1).otherwise(0)


def failures(results: DataFrame, source: str, target: str, error: str, limit: int = 10) -> DataFrame:
    """The first failed rows, in the order of their sources."""
    return results.where(F.coalesce(F.col(error), F.lit("")) != "").select(F.col(source).alias("input"), F.col(target).alias("output"), F.col(error).alias("error")).orderBy("input").limit(limit)


#: Commands with whether they only read, destroy, and may be repeated.
COMMANDS = [
    ("convert", False, False, True), ("compress", False, False, True), ("strip", False, False, True), ("dedup", False, True, False), ("compare", True, False, True), ("crop", False, False, True),
    ("resize", False, False, True), ("rotate", False, False, True), ("watermark", False, False, True), ("montage", False, False, True), ("optimize", True, False, True), ("info", True, False, True),
    ("formats", True, False, True), ("doctor", True, False, True), ("pdf.merge", False, False, True), ("pdf.extract", False, False, True), ("pdf.compress", False, False, True), ("pdf.concat", False, False, True),
    ("pdf.split", False, False, True), ("pdf.info", True, False, True), ("video.info", True, False, True), ("video.convert", False, False, True), ("video.compress", False, False, True), ("video.concat", False, False, True),
    ("video.trim", False, False, True), ("video.thumbnail", False, False, True), ("video.extract-audio", False, False, True), ("video.gif", False, False, True), ("verify", True, False, True), ("tools", True, False, True),
    ("apply", False, False, True), ("prep", False, False, True), ("manifest", True, False, True), ("hash", True, False, True),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """(name, tool, read_only, destructive, idempotent, has_side_effects) of all commands."""
    values = ", ".join(f"('{n}', {r}, {d}, {i})" for n, r, d, i in COMMANDS)
    out = spark.sql(f"SELECT * FROM VALUES {values} AS c(name, read_only, destructive, idempotent)")
    return out.withColumn("tool", F.replace(F.replace("name", F.lit("."), F.lit("_")), F.lit("-"), F.lit("_"))).withColumn("has_side_effects", F.col("destructive") | ~F.col("read_only"))


def media_readiness(checks: DataFrame, ok: str, required: str) -> DataFrame:
    return checks.agg(F.coalesce(F.every(F.col(ok) | ~F.col(required)), F.lit(True)).alias("ready"), F.count("*").alias("checks"))


def plan_counts(plans: DataFrame, by: list[str], command: str, size: str, out: str) -> DataFrame:
    """How many plans change something and how many keep, and the bytes after over those before."""
    keep = F.col(command) == "keep"
    return plans.groupBy(*by).agg(F.count_if(~keep).alias("actionable"), F.count_if(keep).alias("keep"), (F.sum(out).cast("double") / F.nullif(F.sum(size), F.lit(0))).alias("ratio"))


def embedded_counts(images: DataFrame, document: str, reference: str, order: str, replaced: str) -> DataFrame:
    """(document, processed, replaced, skipped): an embedded picture counts once, by its first placement."""
    once = images.groupBy(document, reference).agg(F.min_by(replaced, order).alias("_done"))
    return once.groupBy(document).agg(F.count("*").alias("processed"), F.count_if("_done").alias("replaced"), F.count_if(~F.col("_done")).alias("skipped"))


# -- records as they go over the wire --------------------------------------------


def hash_records(files: DataFrame, path: str, algorithm: str, digest: str, size: str, error: str) -> DataFrame:
    """(path, algorithm, digest, size_bytes, error)."""
    return files.select(F.col(path).alias("path"), F.lit(algorithm).alias("algorithm"), F.col(digest).alias("digest"), F.col(size).cast("long").alias("size_bytes"), F.coalesce(F.col(error), F.lit("")).alias("error"))


def inventory_records(pictures: DataFrame, path: str, digest: str, size: str, tags: str, error: str) -> DataFrame:
    """A picture's record: digest, size, format, dimensions, mode, alpha, frames, and the names of tags that tell about someone, without the tags."""
    from ..sources.files import sensitive_keys

    kept = [c for c in ("format", "width", "height", "mode", "has_alpha", "frame_count") if c in pictures.columns]
    told = F.coalesce(sensitive_keys(F.col(tags)), F.array().cast("array<string>"))
    return pictures.select(F.col(path).alias("path"), F.col(digest).alias("sha256"), F.col(size).cast("long").alias("size_bytes"), *kept, told.alias("sensitive_exif_keys"), F.coalesce(F.col(error), F.lit("")).alias("error"))


def prepared_records(results: DataFrame, source: str, target: str, success: str, skipped: str, size: str, out: str, error: str) -> DataFrame:
    """(input, output, ok, skipped, input_bytes, output_bytes, error); what was skipped is fine."""
    skip = F.coalesce(F.col(skipped), F.lit(False))
    return results.select(
        F.col(source).alias("input"), F.col(target).alias("output"), (F.coalesce(F.col(success), F.lit(False)) | skip).alias("ok"), skip.alias("skipped"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("input_bytes"), F.coalesce(F.col(out), F.lit(0)).cast("long").alias("output_bytes"), F.coalesce(F.col(error), F.lit("")).alias("error"),
    )


def tool_list(spark: SparkSession) -> DataFrame:
    """(name, inputSchema, annotations) of all commands as tools: one array of texts, and what the command does to files."""
    schema = F.to_json(F.struct(F.lit("object").alias("type"), F.struct(F.struct(F.lit("array").alias("type"), F.struct(F.lit("string").alias("type")).alias("items")).alias("args")).alias("properties"), F.lit(False).alias("additionalProperties")))
    notes = F.struct(F.col("read_only").alias("readOnlyHint"), F.col("destructive").alias("destructiveHint"), F.col("idempotent").alias("idempotentHint"))
    return catalogue(spark).select(F.col("tool").alias("name"), schema.alias("inputSchema"), notes.alias("annotations"))
