"""Scratch tables in the folder that driver and executors share. They go when they are discarded, the rest when the JVM ends."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir. Only in local mode, without that setting, a temporary folder."""
    base, app = spark.conf.get("spark.checkpoint.dir", ""), spark.sparkContext.applicationId
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and all executors share")
    key = f"{app}|{base}"
    if key not in _ROOTS:
        root = f"{(base or tempfile.mkdtemp(prefix='tamis-')).rstrip('/')}/tamis-{app}"
        where, fs = _path(spark, root)
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        _ROOTS[key] = root
    return _ROOTS[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of that name that nothing has used yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and lost executors lose nothing.

    by: columns for whose values the rows lie in folders of their own.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise gave and that nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            where, fs = _path(df.sparkSession, path)
            fs.delete(where, True)
