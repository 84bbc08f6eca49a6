"""Scans of files, probe documents and metadata maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extension, frame_rate

#: Parts of metadata names that tell about a person, place or device.
SENSITIVE = ["gps", "make", "model", "serial", "artist", "copyright", "datetime", "hostcomputer", "software", "lens", "owner"]


def scan(spark: SparkSession, folder: str, suffixes: list[str] | None = None, recursive: bool = True, content: bool = True) -> DataFrame:
    """(path, length, modificationTime[, content]) of a folder's files; without ``content`` no bytes are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    out = reader.load(folder)
    if suffixes:
        out = out.where(extension(F.col("path")).isin(suffixes))
    return out if content else out.drop("content")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded pictures: (origin, height, width, nChannels, mode, data); undecodable ones have width -1."""
    return spark.read.format("image").load(folder).select("image.*")


def digest(content: Column, algorithm: str = "sha256") -> Column:
    c = content.cast("binary")
    if algorithm == "blake2b":
        return _blake2b(c)
    return {"sha256": F.sha2(c, 256), "sha512": F.sha2(c, 512), "sha1": F.sha1(c), "md5": F.md5(c)}[algorithm]


def _blake2b(content: Column) -> Column:  # no built-in has it
    import hashlib

    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else hashlib.blake2b(bytes(b)).hexdigest()), "string")(content)


PROBE = (
    "struct<format:struct<format_name:string,duration:string,bit_rate:string>,streams:array<struct<codec_type:string,codec_name:string,pix_fmt:string,width:string,height:string,"
    "avg_frame_rate:string,sample_rate:string,channels:string,disposition:struct<attached_pic:int>>>>"
)


def probed(df: DataFrame, document: str) -> DataFrame:
    """``df`` with the fields of a probe's JSON: of the first video stream that is no cover picture, and the first audio stream."""
    doc = F.from_json(F.col(document), PROBE)
    pick = lambda t, more=None: F.try_element_at(F.filter(doc["streams"], lambda s: (s["codec_type"] == t) & (more(s) if more else F.lit(True))), F.lit(1))
    video = pick("video", lambda s: F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)
    audio = pick("audio")
    number = lambda c: F.when((c.try_cast("double") >= 0) & (c.try_cast("double") < float("inf")), c.try_cast("double")).otherwise(0.0)
    whole = lambda c: F.coalesce(F.floor(number(c)).cast("long"), F.lit(0).cast("long"))
    return df.withColumns({
        "container": doc["format"]["format_name"], "duration": F.coalesce(number(doc["format"]["duration"]), F.lit(0.0)), "bit_rate": whole(doc["format"]["bit_rate"]),
        "video_codec": F.coalesce(video["codec_name"], F.lit("")), "width": whole(video["width"]), "height": whole(video["height"]), "fps": frame_rate(F.coalesce(video["avg_frame_rate"], F.lit("0/0"))),
        "audio_codec": F.coalesce(audio["codec_name"], F.lit("")), "stream_count": F.coalesce(F.size(doc["streams"]), F.lit(0)),
    })


def sensitive_keys(tags: Column) -> Column:
    return F.array_sort(F.filter(F.map_keys(tags), lambda k: F.lower(k).rlike("|".join(SENSITIVE))))


def without_tags(tags: Column, names: list[str]) -> Column:
    """A metadata map without some names, in any case."""
    gone = [n.lower() for n in names]
    return F.map_filter(tags, lambda k, v: ~F.lower(k).isin(gone))
