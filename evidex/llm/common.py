"""Helpers shared by the training-data operators: shared scratch tables and input readers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, as `spark.checkpoint.dir` names it.

    Only where the session names none and runs on one machine (tests) a temporary folder is set and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evidex-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{named}")
        named = f"file://{named}"
    return named.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/evidex/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # for dropped()
    return out


def dropped(*frames: DataFrame | None) -> None:
    """Delete tables of written() that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def remainder(column: str, modulus: int):
    """crc32 of the id written as text, modulo `modulus`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def released() -> None:
    """Give freed memory of this process back to the system (Arrow's pool, glibc)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Of this worker process: one operator's cache, kept from task to task.  A worker that goes on to another operator
#: drops it, so a pipeline's workers never hold more than one.
_worker: dict = {}


def worker_cache(key, make):
    """The cache made under an equal key, or a new one; key: name of the operator and what the cache depends on."""
    if not _worker or _worker["key"] != key:
        _worker.clear()
        gc.collect()
        released()
        _worker.update(key=key, value=make())
    return _worker["value"]
