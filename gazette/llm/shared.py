"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from gazette.session import importable
from gazette.session import scratch as shared_dir

_TABLES: dict[str, list[str]] = {}


def cut(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, with schema where the same bytes are to have another type.

    The lineage ends there: a lost executor costs a reread of some files, and what stands before isn't run again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def cuts(spark: SparkSession) -> list[str]:
    """The tables that this application has cut and not yet removed."""
    return list(_TABLES.get(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more: all that was made from them has been written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _TABLES[spark.sparkContext.applicationId].remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def give_back_memory() -> None:
    """At the end of a Python task: hand freed memory back to the system, as the worker goes on to other work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
