"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one only where none is set."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        path = tempfile.mkdtemp(prefix="depthloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that nothing upstream runs again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/depthloom-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """Write a frame to the shared folder in buckets by `key` and read it back: joins by that key then leave it where it lies."""
    spark = df.sparkSession
    name = f"depthloom_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).saveAsTable(name)
    atexit.register(discard, spark, path)
    return spark.table(name)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that materialise() wrote, if the session still lives."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone at exit; the cluster's own clean-up takes the rest
        pass


def words(text: Column) -> Column:
    """The words of a text, in order; none for null or white space."""
    cut = F.split(F.coalesce(text, F.lit("")), f"{SPACE}+")
    return F.filter(cut, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts) == part


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started; clusters ship it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
