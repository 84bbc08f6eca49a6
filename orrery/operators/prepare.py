"""Pictures prepared for delivery, end to end: scanned, named, checked, processed, published and reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import published, tree
from . import files, planning
from .pictures import processed
from .tables import written

REPORT = ["input", "output", "success", "skipped", "input_bytes", "output_bytes", "sha256", "error"]


class Collision(ValueError):
    """Two sources would write one output, or one would write another's source."""


def prepared(spark: SparkSession, paths: list[str], output: str, fmt: str = "png", longest: int | None = 2048, steps: list[tuple] = (), recursive: bool = False, overwrite: bool = False, system: str = "posix", prefix: str = "", suffix: str = "", flatten: bool = False, **selection) -> DataFrame:
    """One row of ``REPORT`` for each picture of files and folders: scaled to fit ``longest``, after ``steps``, as ``fmt`` below ``output``.

    What lies below ``output`` is no source.  An output has its source's place
    below the argument that holds it (or none, with ``flatten``).  If two
    sources have one output, or an output is a source, under the file system's
    equality of names, nothing is written and :class:`Collision` is raised.
    Outputs that are there are skipped, with their size and digest, unless
    ``overwrite``; a second run so only does what is left.  Pictures that
    can't be read have an error code, as have outputs that can't be published.
    The pictures are written now; the report is a table.
    """
    output = published.local_folder(output).rstrip("/")
    found = tree.pictures(spark, paths, recursive=recursive, **selection)
    found = found.where(~F.startswith("path", F.lit(output + "/")))
    held = planning.closest_root(found, "given", [p.rstrip("/") for p in paths])
    name = planning.output_name(F.col("path"), suffix, prefix, fmt)
    relative = F.when(F.col("relative") == "", planning.file_name(F.col("path"))).otherwise(F.col("relative"))
    tasks = written(held.select(F.col("path").alias("input"), F.col("length").alias("input_bytes"), planning.output_path(F.col("path"), name, output, relative, flatten).alias("output")))
    bad = planning.collisions(tasks, "input", "output", system).select("output").union(planning.aliases(tasks, "input", "output", system).select("output")).limit(1).collect()
    if bad:
        raise Collision(f"output_collision:{bad[0][0]}")
    there = tree.distinct_files(tree.files(spark, [output], recursive=True)).select(F.col("path").alias("output"), F.col("length").alias("output_bytes"))
    state = written(planning.partition_existing(tasks, there, "output", overwrite))
    skipped = state.where("state = 'skipped'").join(there, "output")
    skipped = files.file_digests(skipped.select("input", "output", "input_bytes", "output_bytes"), path="output").select("input", "output", F.lit(True).alias("success"), F.lit(True).alias("skipped"), "input_bytes", "output_bytes", F.col("digest").alias("sha256"), "error")

    pending = state.where("state = 'pending'").select("input", "output", "input_bytes")
    seen = spark.read.format("image").option("recursiveFileLookup", "true").load([f"file://{p}" for p in paths]).select("image.*") if not pending.isEmpty() else None
    if seen is None:
        return skipped.select(*REPORT)
    seen = seen.withColumn("path", F.regexp_replace("origin", "^file:/*", "/"))
    # pictures found by links or in folders named by links are met by their resolved paths
    pictures = pending.join(seen, pending["input"] == seen["path"], "left").select(F.col("input").alias("origin"), "height", "width", "nChannels", "data")
    made = written(processed(pictures, [*([("fit", longest)] if longest else []), *steps], fmt))
    done = pending.join(made, pending["input"] == made["origin"])
    report = published.publish(done.where("error = ''"), output, "output", "content", overwrite=overwrite)
    out = done.select("input", "output", "input_bytes", "error").join(report.select(F.col("path").alias("output"), F.col("bytes"), F.col("sha256"), F.col("error").alias("failed")), "output", "left")
    error = F.coalesce(F.nullif("error", F.lit("")), "failed")
    fresh = out.select("input", "output", (error == "").alias("success"), F.lit(False).alias("skipped"), "input_bytes", F.coalesce("bytes", F.lit(0)).alias("output_bytes"), "sha256", error.alias("error"))
    return fresh.select(*REPORT).unionByName(skipped.select(*REPORT))
