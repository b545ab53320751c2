"""Exact deduplication with two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts rows by filter slot, two slots a text hash in two bit arrays; slots with more than one row become bitmaps.
Pass 2 looks both slots of each row up in the bitmaps, which are broadcast (2 * ``max_bits`` / 8 bytes at most). A text
that is repeated always has both bits set, so rows without go straight through, unshuffled. Only the others are grouped
by their full SHA-256, with map-side aggregation, so that a group of any size leaves a row per task. What a large group
keeps is broadcast to its rows, so that these are never gathered in one task.

The filter has 8 bits a row. If that is more than ``max_bits``, rows are dealt by their hash into folders, without a shuffle,
and each folder has both passes with a filter of its own, one folder after the other: it never fills, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .common import discard, join_groups, materialise

#: White space that doesn't count, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BITMAP_BITS = 32_768
MAX_BITS = 1 << 29


def text_key(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without white space; null counts as empty."""
    plain = reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))
    return F.sha2(plain.cast("binary"), 256)


def hex_slot(key: str, probe: int) -> Column:
    """13 hex digits of a hash, another stretch for each probe."""
    return F.conv(F.substring(F.col(key), 1 + 16 * probe, 13), 16, 10).cast("bigint")


def possibly_repeated(rows: DataFrame, keys: DataFrame, key: str, max_bits: int = MAX_BITS, probes: int = 2, slot: Callable[[str, int], Column] = hex_slot, total: int | None = None) -> DataFrame:
    """rows with a boolean column __repeated, true for every row whose key is not alone in keys and for a few others.

    slot gives a number of 0 or more for a key's column and a probe; its remainder by the filter's size is the key's slot.
    total: the number of keys, if it is known.
    """
    total = keys.count() if total is None else total
    parts = max(1, -(-8 * total // max_bits))
    bits = max(1, -(-8 * total // (parts * BITMAP_BITS))) * BITMAP_BITS
    if parts == 1:
        return _looked_up(rows, keys, key, bits, probes, slot)
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    dealt = [materialise(df.withColumn("__pass", part), "bloom-dealt", "__pass") for df in (rows, keys.select(key))]
    path, spark = scratch_path(rows.sparkSession, "bloom-marked"), rows.sparkSession
    for p in range(parts):
        own, own_keys = (df.where(F.col("__pass") == p).drop("__pass") for df in dealt)
        marked = _looked_up(own, own_keys, key, bits, probes, slot)
        marked.write.parquet(f"{path}/__pass={p}")
    discard(*dealt)
    return spark.read.schema(marked.schema).parquet(path).select(*marked.columns)


def _looked_up(rows: DataFrame, keys: DataFrame, key: str, bits: int, probes: int, slot: Callable[[str, int], Column]) -> DataFrame:
    """Both passes with one filter of that size."""
    found, hit = rows, F.lit(True)
    for probe in range(probes):
        seen = keys.groupBy((slot(key, probe) % bits).alias("__slot")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        bitmap = seen.groupBy(F.expr(f"__slot div {BITMAP_BITS}").alias(f"__b{probe}")).agg(F.bitmap_construct_agg(F.col("__slot") % BITMAP_BITS).alias(f"__m{probe}"))
        found = found.withColumn(f"__s{probe}", slot(key, probe) % bits).withColumn(f"__b{probe}", F.expr(f"__s{probe} div {BITMAP_BITS}"))
        found = found.join(F.broadcast(materialise(bitmap, "bloom-bitmap")), f"__b{probe}", "left")
        at = F.col(f"__s{probe}") % BITMAP_BITS
        byte = F.conv(F.hex(F.substring(F.col(f"__m{probe}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = hit & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return found.withColumn("__repeated", hit).drop(*(f"__{c}{p}" for c in "sbm" for p in range(probes)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, so empty, blank and null texts are one group.
    Of a group the row with the most code points in its original text stays, then the smallest id; a null id comes last.
    Ids of any type that can be ordered will do. Of repeated rows with one id exactly one is kept. An empty table gives no rows; other columns are not carried.
    """
    narrow = docs.select(F.col(id_col).alias("__id"), text_key(F.col(text_col)).alias("__key"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("__chars"))
    narrow = materialise(narrow.withColumn("__row", F.monotonically_increasing_id()), "exact-keys")
    marked = materialise(possibly_repeated(narrow, narrow, "__key", max_bits), "exact-marked")
    alone = marked.where(~F.col("__repeated")).select(
        F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("__key").alias("text_sha256")
    )
    again = marked.where("__repeated")
    # The best row of a group: most code points, a non-null id, the smallest id, the first row.
    best = F.struct((-F.col("__chars")).alias("__neg"), F.col("__id").isNull().alias("__unknown"), "__id", "__row")
    groups = materialise(again.groupBy("__key").agg(F.min(best).alias("__best"), F.count(F.lit(1)).alias("__n")), "exact-groups")
    grouped = join_groups(again.drop("__repeated"), groups, "__key", "__n", narrow.count()).select(
        F.col("__id").alias(id_col), F.col("__best.__id").alias("keep_id"), F.col("__n").alias("group_size"),
        (F.col("__row") == F.col("__best.__row")).alias("kept"), F.col("__key").alias("text_sha256"),
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each group of equal texts, chosen as in report(), and the columns as they were.

    Rows that are alone are not shuffled. Repeated ones are reduced by a min_by over whole rows, map side first.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), text_key(F.col(text_col)).alias("__key"))
    keys = materialise(keyed.select("__key"), "exact-keys")
    marked = possibly_repeated(keyed, keys, "__key", max_bits)
    alone = marked.where(~F.col("__repeated")).select("__doc")
    text, doc_id = F.col(f"__doc.{text_col}"), F.col(f"__doc.{id_col}")
    best = F.struct((-F.coalesce(F.char_length(text), F.lit(0))).alias("a"), doc_id.isNull().alias("b"), doc_id.alias("c"), F.xxhash64(F.to_json("__doc")).alias("d"))
    again = marked.where("__repeated").groupBy("__key").agg(F.min_by("__doc", best).alias("__doc")).select("__doc")
    return alone.unionByName(again).select("__doc.*")
