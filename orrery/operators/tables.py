"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode, where driver and executors are one process."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="orrery-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


@contextlib.contextmanager
def _shuffles_cleared(spark: SparkSession):
    """What frames made inside have shuffled goes when their query ends: their result is kept, so nothing reads it again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def written(df: DataFrame, rows_a_file: int = 0, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    Unlike a cache this survives lost executors.  :func:`dropped` frees the
    files of an intermediate; what a returned frame still reads stays in the
    folder, which belongs to the application.  ``rows_a_file`` keeps files
    with very large rows short, since readers hold a file's rows in batches.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery-{uuid.uuid4().hex}"
    with _shuffles_cleared(spark):
        df.select("*").write.option("maxRecordsPerFile", rows_a_file).option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orrery_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written`."""
    path = getattr(df, "_orrery_path", None)
    if path:
        try:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; the folder's owner cleans up
            pass
