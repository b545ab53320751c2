"""Small JSON files in any store that Spark writes, and the names in a folder of it."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Replace a file; a reader sees the old one, none for a moment, or the new one whole."""
    where, fs = _place(spark, path)
    beside, _ = _place(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(where.getParent())
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if not fs.rename(beside, where):
        fs.delete(where, False)
        fs.rename(beside, where)


def read_json(spark: SparkSession, path: str, default: Any = None) -> Any:
    where, fs = _place(spark, path)
    if not fs.exists(where):
        return default
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, without hidden and unfinished files; none if it is not there."""
    where, fs = _place(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in found if not n.startswith((".", "_")) and not n.endswith(".tmp"))
