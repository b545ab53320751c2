"""Column profiles: completeness, distinct values and, of numbers, min, max, mean, deviation and sum."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bifurcate import key_id
from .schema_contract import canonical_type

SAMPLE_SEED = 42


def sample(df: DataFrame, sample_size: float | int | None) -> DataFrame:
    """A share of the rows (a number up to 1) or about so many rows, seeded; df itself for None."""
    if sample_size is None:
        return df
    share = float(sample_size) if 0 < sample_size <= 1 else min(1.0, sample_size / max(1, df.count()))
    return df if share >= 1 else df.sample(fraction=share, seed=SAMPLE_SEED)


def _countable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _countable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_countable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def profile_df(df: DataFrame, approx: bool = True) -> DataFrame:
    """One row per column. One pass with approx (distinct counts by sketch, within 5 % or so); else one grouping more, for all columns."""
    measures: list[Column] = [F.count(F.lit(1)).alias("n")]
    exact: list[tuple[int, str]] = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        measures.append(F.count(c).alias(f"c{i}"))
        if not _countable(f.dataType):
            measures.append(F.lit(None).cast("bigint").alias(f"d{i}"))
        elif approx:
            measures.append(F.approx_count_distinct(c).alias(f"d{i}"))
        else:
            exact.append((i, f.name))
        if isinstance(f.dataType, T.NumericType):
            v = c.cast("double")
            measures += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"avg{i}"), F.stddev_samp(v).alias(f"std{i}"), F.sum(v).alias(f"sum{i}")]
    row = df.agg(*measures)
    if exact:  # one shuffle for all columns, of distinct ids of 32 bytes at most, map side first
        ids = F.array(*(F.struct(F.lit(i).alias("i"), F.when(F.col(f"`{name}`").isNotNull(), key_id(df, [name]).cast("binary")).alias("id")) for i, name in exact))
        values = df.select(F.explode(ids).alias("v")).select("v.*").where("id is not null").distinct()
        row = row.join(F.broadcast(values.agg(*(F.count_if(F.col("i") == i).alias(f"d{i}") for i, _ in exact))))
    none = F.lit(None).cast("double")
    entries = []
    for i, f in enumerate(df.schema.fields):
        number = isinstance(f.dataType, T.NumericType)
        n, known, distinct = F.col("n"), F.col(f"c{i}"), F.col(f"d{i}")
        figures = zip(("min", "max", "mean", "std_dev", "sum"), ("lo", "hi", "avg", "std", "sum"), strict=True)
        entries.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(canonical_type(f.dataType)).alias("type"), F.lit(f.nullable).alias("nullable"), n.alias("row_count"),
                F.when(n > 0, known / n).otherwise(F.lit(1.0)).alias("completeness"), (n - known).alias("null_count"), distinct.alias("distinct_count"),
                F.when(n > 0, F.round(distinct / n, 4)).otherwise(F.lit(0.0)).alias("uniqueness"), *((F.col(f"{k}{i}") if number else none).alias(name) for name, k in figures),
            )
        )
    return row.select(F.explode(F.array(*entries)).alias("p")).select("p.*")


def profile(df: DataFrame, sample_size: float | int | None = None, approx: bool = False) -> dict[str, Any]:
    """table_stats and column_profiles; strings and dates have no numeric figures."""
    began = time.time()
    rows = profile_df(sample(df, sample_size), approx).collect()
    columns = {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in rows}
    total = rows[0]["row_count"] if rows else 0
    return {"table_stats": {"total_rows": total, "execution_time_ms": round(1000 * (time.time() - began), 2), "columns_count": len(columns), "sampled": sample_size is not None}, "column_profiles": columns}
