"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[tuple[str, str]] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their
    Python workers import it by name and keep module-level caches between tasks."""
    files = sorted(_PACKAGE.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    key = (spark.sparkContext.applicationId, digest)
    if key in _shipped:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="confluo-"))
    archive = os.path.join(folder, f"confluo-{digest}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in files:
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(key)


def release() -> None:
    """Give the memory that the allocators hold free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean(run):
    """``run`` for mapInArrow, with ``release`` at a task's end: Python workers outlive
    their tasks, so the peaks of all stages would add up in an executor otherwise."""

    def released(batches):
        yield from run(batches)
        release()

    return released


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset, a local master
    gets a temporary folder; a cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="confluo-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.  The
    table lives as long as the application does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/confluo/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
