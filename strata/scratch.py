"""Intermediate tables in the cluster's shared folder: what ends the lineage of iterations, and what several queries read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_STAGED: dict[tuple, DataFrame] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset in a single process, as in tests, one is made; on a cluster an unset folder is an error, because
    a folder of one machine isn't seen by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOT:
            _LOCAL_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="strata-")
        root = _LOCAL_ROOT[app]
    return root.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """build(), written once in a session for as long as the files or folders it is built from stay as they are."""
    key = [spark.sparkContext.applicationId, name]
    for source in sources:
        path = spark._jvm.org.apache.hadoop.fs.Path(source)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        key.append((source, status.getLen(), status.getModificationTime()))
    if tuple(key) not in _STAGED:
        _STAGED[tuple(key)] = cut(build(), name)
    return _STAGED[tuple(key)]
