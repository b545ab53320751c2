"""Uniqueness on a stream: each row is told whether its key came before, by keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While a query is started: the state store that keyed state needs, which spills to disk. A running query keeps its own."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Seen(StatefulProcessor):
    """For each key the latest event time seen, in milliseconds; a timer clears it once the watermark is `keep` beyond that."""

    def __init__(self, columns: Sequence[str], flag: str, order: Sequence[str], time: str | None, keep: int | None) -> None:
        self.columns, self.order, self.time, self.keep = list(columns), list(order), time, keep
        self.result = Row(*columns, flag)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ms bigint", self.keep if self.time is None else None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        """Rows are passed on as they come; only the first in order so far is held back."""
        held = self.latest.get()
        newest = held[0] if held else None
        first, rank = None, None
        before = held is not None
        for row in rows:
            if self.time is not None and row[self.time] is not None:
                ms = int(row[self.time].timestamp() * 1000)
                newest = ms if newest is None else max(newest, ms)
            if before:
                yield self.result(*(row[c] for c in self.columns), True)
                continue
            own = tuple((row[c] is not None, row[c]) for c in self.order)
            if first is not None and rank <= own:
                yield self.result(*(row[c] for c in self.columns), True)
                continue
            if first is not None:
                yield self.result(*(first[c] for c in self.columns), True)
            first, rank = row, own
        if first is not None:
            yield self.result(*(first[c] for c in self.columns), False)
        self.latest.update((newest if newest is not None else 0,))
        if self.time is not None and newest is not None:
            if held and held[0] != newest:
                self.handle.deleteTimer(held[0] + self.keep)
            self.handle.registerTimer(newest + self.keep)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def flag_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str = "seen_before", time_col: str | None = None, watermark: str = "0 seconds", keep_ms: int | None = None) -> DataFrame:
    """A stream's rows with a boolean column: whether a row of the same keys came in an earlier batch, or in this one and is earlier in order.

    Nulls are equal to each other. With time_col a key is forgotten once the watermark is keep_ms beyond the last time that it was seen;
    rows later than the watermark are still flagged and passed on. Without it keep_ms is a time of the clock, and None keeps keys for ever.
    Start the query inside keyed_state(). State is a number for each key; the rows of a key in one batch pass through one task, one after
    the other, so that a source's limits on its batches bound them.
    """
    if time_col is not None and keep_ms is None:
        raise ValueError("with time_col, keep_ms says how long a key is kept")
    source = df
    if time_col:  # the watermark is on a copy that goes no further, so that no late row is left out
        source = df.withColumn("__at", F.col(f"`{time_col}`")).withWatermark("__at", watermark).select(*(F.col(f"`{c}`") for c in df.columns))
    kinds = T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())])
    grouped = source.groupBy(*(F.col(f"`{k}`") for k in keys))
    return grouped.transformWithState(_Seen(df.columns, flag, order, time_col, keep_ms), kinds, "Append", "EventTime" if time_col else "ProcessingTime" if keep_ms else "None")


class _Late(StatefulProcessor):
    """For each key the rows so far and those that came after the watermark."""

    def __init__(self, keys: Sequence[str], time: str) -> None:
        self.time, self.result = time, Row(*keys, "rows", "late")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "n bigint, late bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        n, late = self.counts.get() or (0, 0)
        limit = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            n += 1
            late += row[self.time] is not None and row[self.time].timestamp() * 1000 < limit
        self.counts.update((n, late))
        yield self.result(*key, n, late)

    def close(self) -> None:
        pass


def count_late(df: DataFrame, time_col: str, watermark: str, by: Sequence[str]) -> DataFrame:
    """A stream of by, rows, late: how many rows each key has had so far, and how many of them were later than the watermark when they came.

    A key's row is given again with each batch that has rows of it (mode "update"). These are the rows that windows on the same watermark
    leave out. Start the query inside keyed_state().
    """
    source = df.withColumn("__at", F.col(f"`{time_col}`").cast("timestamp")).withColumn("__time", F.col("__at")).withWatermark("__at", watermark).select(*by, F.col("__time"))
    kinds = T.StructType([*(df.schema[k] for k in by), T.StructField("rows", T.LongType()), T.StructField("late", T.LongType())])
    return source.groupBy(*by).transformWithState(_Late(by, "__time"), kinds, "Update", "EventTime")
