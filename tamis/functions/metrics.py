"""Aggregates of the table checks, as columns that go into one pass, and the figures that need a grouping of their own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Exact distinct counts in the fused pass; with a second, every row would be copied for each of them.
DISTINCT_IN_PASS = 1


def measured_column(check: str, name: str, kind: T.DataType) -> Column:
    """What a table check aggregates: the field, which for sums and means is tried as a number."""
    c = F.col(f"`{name}`")
    return c.try_cast("double") if check in ("has_sum", "has_mean", "has_std") and not isinstance(kind, T.NumericType) else c


def aggregate(check: str, name: str, kind: T.DataType, approx: bool, rows: Column | None = None) -> Column:
    """The aggregate of a field; of the rows where rows holds, if given."""
    c = measured_column(check, name, kind)
    if rows is not None:
        c = F.when(rows, c)
    if check == "has_cardinality":
        return F.approx_count_distinct(c) if approx else F.count_distinct(c)
    return {"has_min": F.min, "has_max": F.max, "has_sum": F.sum, "has_mean": F.avg, "has_std": F.stddev_samp}[check](c)


@dataclass(frozen=True)
class Group:
    """Figures of one grouping: rows in groups of two or more, distinct groups, entropy in bits of the groups without null."""

    duplicates: int
    groups: int
    entropy: float | None


def group_row(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: duplicates, groups, entropy of grouping df by keys."""
    names = [F.col(f"`{k}`") for k in keys]
    known = names[0].isNotNull()
    for n in names[1:]:
        known = known & n.isNotNull()
    counts = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"), F.first(known).alias("__known"))
    n = F.when(F.col("__known"), F.col("__n").cast("double"))
    # H = log2(N) - sum(n log2 n) / N
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).cast("bigint").alias("duplicates"),
        F.count(F.lit(1)).cast("bigint").alias("groups"),
        (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"),
    )


def information_gain(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, gain: H(y) - H(y | x) in bits over the rows where both are known, from one cube."""
    both = df.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")).where("x is not null and y is not null")
    cube = both.cube("x", "y").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).cast("double").alias("n"))
    total = F.max(F.when(F.col("level") == 3, F.col("n")))

    def spread(level: int) -> Column:
        return F.sum(F.when(F.col("level") == level, F.col("n") * F.log2("n"))) / total

    # H(x) + H(y) - H(x, y); levels: 0 both, 1 x alone, 2 y alone, 3 all rows.
    return cube.agg((F.log2(total) - spread(1) - spread(2) + spread(0)).alias("gain"))
