"""Intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session.  Where none is set, a session
on one machine, as in tests, gets a temporary one; on a cluster that is an error, as a
folder local to each machine would lose rows.  Every table has a path of its own, and
all of a process's tables are removed when it ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _local.get("folder") or "file://" + tempfile.mkdtemp(prefix="lexmill-")
        _local["folder"] = found
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{folder(spark)}/lexmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a new table and read it back, cutting lineage."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
