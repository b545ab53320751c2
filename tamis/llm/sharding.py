"""Proportional stratified interleaving: shards whose row counts are equal and whose source mixture is that of the corpus.

Rows are ranked in a seeded shuffle within their source. Rank r of n rows becomes the fraction (r - phase) / n, with a
seeded phase in (0, 1) for each source, so that small sources don't all meet at one point. Sorted by that fraction, any
stretch of the order holds each source in proportion, and equal cuts of the order are the shards.

Both rankings are over buckets of a uniform key (hash, then fraction), each of about ``bucket_rows`` rows, with bucket
counts added up first. No source and no shard ever meets in one task, however large, and only narrow rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HASH_BITS, hash52, materialise

BUCKET_ROWS = 50_000


def _starts(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Add __start, the rows in buckets before this one, and __all, the rows in all buckets."""
    whole = Window.partitionBy(*by)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__all", F.sum("__n").over(whole))


def interleave(docs: DataFrame, shards: int = 8, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: id, source, size, text_crc32, fraction, shard, slot.

    Law ``rows``: shard sizes differ by at most one; slots are gapless from 0 in the interleaved order.
    size is the UTF-8 bytes of the text (null: none) plus 1. A null source is a source of its own. Rows with a null id are
    placed by their text. Rows that are equal in id and text are told apart arbitrarily, and then are interchangeable; rows of one id
    have one hash and so lie in one bucket, which one task ranks.
    An empty table gives no rows. Other columns are not carried, so their names don't matter.
    """
    raw = F.col(text_col).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("__stratum"),
        (F.coalesce(F.octet_length(raw), F.lit(0)).cast("bigint") + 1).alias("__size"),
        F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("__crc"),
    ).withColumn("__h", hash52(seed, F.coalesce(F.col("__id").cast("string"), F.concat(F.lit("crc"), F.col("__crc")))))
    narrow = materialise(narrow, "shard-rows")
    buckets = max(1, -(-narrow.count() // bucket_rows))

    def bucket(part: Column) -> Column:
        return F.least(F.floor(part * buckets), F.lit(buckets - 1)).cast("bigint")

    rows = narrow.withColumn("__b", bucket(F.col("__h") / F.lit(float(1 << HASH_BITS))))
    counts = _starts(rows.groupBy("__stratum", "__b").agg(F.count(F.lit(1)).alias("__n")), ["__stratum"], "__b")
    inner = Window.partitionBy("__stratum", "__b").orderBy("__h", "__id", "__crc", "__size")
    phase = (hash52(f"{seed}-phase", F.col("__stratum")) + 0.5) / F.lit(float(1 << HASH_BITS))
    ranked = rows.join(counts, ["__stratum", "__b"]).withColumn("__rank", F.col("__start") + F.row_number().over(inner))
    ranked = ranked.select("__id", "__source", "__stratum", "__size", "__crc", "__h", ((F.col("__rank") - phase) / F.col("__all")).alias("__f"))
    ranked = materialise(ranked.withColumn("__b", bucket(F.col("__f"))), "shard-fractions")

    cuts = _starts(ranked.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")), [], "__b")
    order = Window.partitionBy("__b").orderBy("__f", "__stratum", "__h", "__id", "__crc", "__size")
    placed = ranked.join(cuts, "__b").withColumn("__at", F.col("__start") + F.row_number().over(order) - 1)
    shard = F.expr(f"cast((__at * {shards}) div __all as int)")
    first = F.expr(f"((cast((__at * {shards}) div __all as bigint)) * __all + {shards - 1}) div {shards}")
    return placed.select(
        F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.col("__f").alias("fraction"), shard.alias("shard"), (F.col("__at") - first).cast("bigint").alias("slot"),
    )
