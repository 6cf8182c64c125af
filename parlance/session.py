"""Makes a session ready: the library on the executors, and batches that small workers can hold."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of the session's workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="parlance-"), "parlance.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> None:
    """ship(), and batches for Python of 1000 rows and 8 MB at most, so that a worker needs little memory.

    These two options stay set in the session, as results are computed later; a caller who needs others sets them afterwards.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def _base(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="parlance-")  # one machine
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/parlance/{sc.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), by application.

    What lies there is read when results are computed; clean() deletes it."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder. Results that aren't stored yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a small table that several branches of a job use to the shared folder, and reads it: it is made once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
