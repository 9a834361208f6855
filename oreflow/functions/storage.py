"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the
session runs on one machine (as in tests) a temporary local folder is chosen.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}
"""By application: the folder chosen where none is set; deleted when the driver ends."""


def shared_folder(spark: SparkSession) -> str:
    """The shared folder as a URI, without a trailing slash."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            folder = tempfile.mkdtemp(prefix="oreflow-")
            _own[app] = f"file://{folder}"
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = _own[app]
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/oreflow/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder (``options`` are the writer's) and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._oreflow_path = path
    return out


def settled(df: DataFrame, name: str, **options: str) -> DataFrame:
    """:func:`kept`, after which the exchanges that made the table leave the disk at once, not when the driver collects its garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return kept(df, name, **options)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def dropped(df: DataFrame) -> None:
    """Delete a table that :func:`kept` wrote and nothing reads any more."""
    spark, path = df.sparkSession, df._oreflow_path
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
