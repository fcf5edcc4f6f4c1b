"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
_OWN_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode, an own one where that is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="spark-gazette-")
    return _OWN_DIRS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: computed once however often it is read, also when executors are lost."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_tables(spark: SparkSession) -> list[str]:
    """The tables that this application has written and not yet removed."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def remove_written(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of written() that nothing reads any more: all that was made from them has been written."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _WRITTEN[spark.sparkContext.applicationId].remove(path)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library where the driver did, without an install.

    On a cluster whose nodes don't have this folder, submit the package with --py-files instead.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark
