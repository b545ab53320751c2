"""Loading and saving tables by file suffix, tables by name, and JDBC tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .excel import read_excel

#: Reader and writer options by suffix.
_FORMATS: dict[str, tuple[str, dict[str, Any]]] = {
    "csv": ("csv", {"header": True, "inferSchema": True}),
    "parquet": ("parquet", {}),
    "pq": ("parquet", {}),
    "json": ("json", {"multiLine": True}),
    "jsonl": ("json", {}),
    "ndjson": ("json", {}),
    "orc": ("orc", {}),
}
_EXCEL = ("xlsx", "xlsm")


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything a glob stands for, is there, in any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def load_data(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """A table from CSV (with header), Parquet, JSON (whole documents), JSON lines, ORC or Excel (.xlsx; option sheet)."""
    kind = suffix(path)
    if kind not in _FORMATS and kind not in _EXCEL:
        raise ValueError(f"unsupported file format '.{kind}'")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if kind in _EXCEL:
        return read_excel(spark, path, **options)
    name, own = _FORMATS[kind]
    return spark.read.format(name).options(**{**own, **options}).load(path)


def save_data(df: DataFrame, path: str, mode: str = "overwrite", **options: Any) -> None:
    """Write a table in the format of the path's suffix; a folder of part files, as Spark writes."""
    kind = suffix(path)
    if kind not in _FORMATS:
        raise ValueError(f"unsupported file format '.{kind}'")
    name, _ = _FORMATS[kind]
    own = {"header": True} if name == "csv" else {}
    df.write.mode(mode).format(name).options(**{**own, **options}).save(path)


def load_table(spark: SparkSession, name: str) -> DataFrame:
    """A table or view of the catalog."""
    return spark.table(name)


def load_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 16, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A warehouse's table over JDBC; with a numeric key read by that many connections, between its least and greatest value."""
    props = dict(properties or {})
    if key is None:
        return spark.read.jdbc(url, table, properties=props)
    low, high = spark.read.jdbc(url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) b", properties=props).first()
    if low is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=partitions, properties=props)
