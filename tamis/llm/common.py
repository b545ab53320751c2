"""Helpers that the operators share: scratch tables, exact 52-bit hashes, size-checked joins, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise

__all__ = ["BROADCAST_ROWS", "HASH_BITS", "arrow_map", "bounded_broadcast", "discard", "hash52", "join_copies", "join_groups", "materialise", "release_memory", "text_chunks"]

#: Rows up to which a list of ids or keys (at most some 40 bytes a row) is broadcast.
BROADCAST_ROWS = 1_000_000
#: A total is split by this: so many groups at most are large, and are broadcast.
HOT_GROUPS = 100_000
#: Texts are handed to a kernel in pieces of about so many bytes.
CHUNK_BYTES = 1 << 20

HASH_BITS = 52

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _TRIM = None


def hash52(seed: str, *cols: Column) -> Column:
    """An integer below 2**52 from md5, the same in any engine that has md5. Nulls count as the text 'null'."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 13), 16, 10).cast("bigint")


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most limit rows, else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, limit: int = HOT_GROUPS, how: str = "inner") -> DataFrame:
    """rows (total of them) joined with groups by key; size is a column of groups, the number of rows that a group has.

    All groups are broadcast if they are limit or fewer. Else those with more than total / limit rows, of which there are fewer
    than limit, are, so that rows of a large group stay where they are. The others' rows are shuffled, at most total / limit to a key.
    how: "inner" or "left".
    """
    least = total // limit
    if not least or groups.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(groups), key, how)
    large = groups.where(F.col(size) > least)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    return rows.join(F.broadcast(large), key).unionByName(rest.join(groups.where(F.col(size) <= least), key, how))


def join_copies(rows: DataFrame, texts: DataFrame, key: str, spread: Column, most: int, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with texts, which have one row for each key.

    A key's rows are dealt to parts of about most rows by the hash spread, and its text is copied to each part: no task gets all
    rows of a key. Keys of one part, nearly all, have one copy. counted: a stored table with the keys of rows, so that rows are
    not made twice.
    """
    parts = (rows if counted is None else counted).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__parts")).where("__parts > 1")
    parts = bounded_broadcast(materialise(parts, "parts"))
    dealt = rows.join(parts, key, "left").withColumn("__part", F.coalesce(F.pmod(spread, F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))
    return dealt.join(texts.join(parts, key, "left").withColumn("__part", copies).drop("__parts"), [key, "__part"]).drop("__part")


def release_memory() -> None:
    """Give memory that is free back to the system: workers are used again by later stages, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def text_chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about size bytes of text; a longer text is a piece of its own, whole."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)
    release_memory()


def arrow_map(df: DataFrame, text: str, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow with the kernel applied to pieces of about size bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_chunks(batch, text, size):
                yield kernel(piece)

    return df.mapInArrow(run, schema)
