"""Annotating rows with the rules that they break, and splitting a table by that."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.planner import BoundRule, ValidationPlan
from ..sources.scratch import materialise

ERRORS = "_dq_errors"
#: Bytes of repeated keys up to which they are broadcast to flag rows, of a key with what its row needs, bits of the filter beyond that,
#: and keys that are too frequent for a shuffle.
BROADCAST_BYTES = 64 << 20
KEY_BYTES = 64
FILTER_BITS = 1 << 28
BITMAP_BITS = 32_768
HOT_KEYS = 10_000
_PARTS = ("rule_id", "check_type", "field", "category", "expected", "actual", "message", "timestamp")
ERROR_TYPE = "array<struct<" + ",".join(f"{p}:string" for p in _PARTS) + ">>"


def error_struct(b: BoundRule, fields: Sequence[str]) -> Column:
    """What is told of a row that breaks a rule; actual is the row's own value or values."""
    rule = b.rule
    own = [F.col(f"`{f}`").cast("string") for f in rule.fields if f in fields]
    actual = own[0] if len(own) == 1 else F.to_json(F.struct(*(F.col(f"`{f}`") for f in rule.fields))) if own else F.lit(None).cast("string")
    values = {
        "rule_id": F.lit(b.rule_id), "check_type": F.lit(rule.check_type), "field": F.lit(rule.label), "category": F.lit(rule.category),
        "expected": F.lit(None if rule.value is None else str(rule.value)).cast("string"), "actual": actual,
        "message": F.lit(f"{rule.check_type} failed"), "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
    }
    return F.struct(*(values[p].alias(p) for p in _PARTS))


def key_id(df: DataFrame, keys: Sequence[str]) -> Column:
    """A short value that tells keys apart, the same for equal ones; never null: 32 bytes at most, whatever the keys' width.

    One number, date or truth value is its own text; anything else is the SHA-256 of all values, each with its length.
    """
    kinds = [df.schema[k].dataType for k in keys]
    texts = []
    for k, kind in zip(keys, kinds, strict=True):
        c = F.col(f"`{k}`")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0).cast(kind)  # -0.0 and 0.0 are equal
        texts.append(F.to_json(F.struct(c.alias("v"))) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string"))
    nulls = [F.col(f"`{k}`").isNull() for k in keys]
    if len(keys) == 1 and isinstance(kinds[0], (T.IntegralType, T.DateType, T.BooleanType)):
        return F.when(nulls[0], F.lit("")).otherwise(texts[0])
    parts = [F.when(n, F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for n, t in zip(nulls, texts, strict=True)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _maybe_repeated(rows: DataFrame, repeated: DataFrame, count: int) -> DataFrame:
    """rows with __maybe: true for all whose __k is in repeated, and for few others. A bitmap of 16 bits a key, FILTER_BITS at most, is broadcast."""
    bits = max(1, min(FILTER_BITS, 16 * count) // BITMAP_BITS) * BITMAP_BITS

    def slot(df: DataFrame) -> DataFrame:
        return df.withColumn("__s", F.pmod(F.xxhash64("__k"), F.lit(bits))).withColumn("__b", F.expr(f"__s div {BITMAP_BITS}"))

    bitmap = slot(repeated).groupBy("__b").agg(F.bitmap_construct_agg(F.col("__s") % BITMAP_BITS).alias("__m"))
    at = F.col("__s") % BITMAP_BITS
    byte = F.conv(F.hex(F.substring("__m", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = slot(rows).join(F.broadcast(materialise(bitmap, "dq-bitmap")), "__b", "left")
    return found.withColumn("__maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("__s", "__b", "__m")


def flag_duplicates(df: DataFrame, keys: Sequence[str], flag: str, where: str | None = None) -> DataFrame:
    """df with a boolean column, true for every row whose keys occur more than once; nulls are equal to each other.

    One job counts the keys, by ids of 32 bytes at most and map side first, and stores those that are repeated. If all of them fit in
    BROADCAST_BYTES, they are broadcast and no row moves. Else a bitmap lets pass, unshuffled, all rows that are surely alone, keys with more
    than a HOT_KEYS-th of the rows are broadcast, so that theirs stay where they are, and only the other rows are joined by a shuffle.
    """
    held = F.coalesce(F.expr(f"({where})"), F.lit(False)) if where else F.lit(True)
    keyed = df.withColumn("__k", F.when(held, key_id(df, keys)) if where else key_id(df, keys))
    counts = keyed.where("__k is not null").groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    repeated = materialise(counts.where("__n > 1"), "dq-repeated")
    size, most = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0))).first()
    marked = repeated.select("__k", F.lit(True).alias(flag))
    if size * KEY_BYTES <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(marked), "__k", "left").drop("__k").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    told = _told(keyed, repeated, size, most)
    stay = told.where(~F.col("__moves")).withColumn(flag, F.col("__hot"))
    dealt = told.where("__moves").join(marked.hint("merge"), "__k", "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return stay.unionByName(dealt).drop("__k", "__moves", "__hot")


def _told(keyed: DataFrame, repeated: DataFrame, size: int, most: int) -> DataFrame:
    """Rows with __hot, true for those of a frequent key, and __moves, for others that may be repeated. size: keys; most: their rows."""
    # Fewer than HOT_KEYS keys have more than that many rows.
    hot = repeated.where(F.col("__n") > max(1, most // HOT_KEYS)).select("__k", F.lit(True).alias("__hot"))
    found = _maybe_repeated(keyed, repeated, size).join(F.broadcast(hot), "__k", "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    return found.withColumn("__moves", F.col("__k").isNotNull() & F.col("__maybe") & ~F.col("__hot")).drop("__maybe")


def annotate(plan: ValidationPlan, rule_ids: set[str] | None) -> DataFrame:
    """The table with _dq_errors, one entry for each of the rules (all, if None) that a row breaks. A column of that name is replaced.

    Lazy but for uniqueness rules, each of which counts its keys in a job first.
    """
    df = plan.df.drop(ERRORS)
    fields = df.columns
    entries, flags = [], []
    for i, b in enumerate(plan.bound):
        if b.error or (rule_ids is not None and b.rule_id not in rule_ids):
            continue
        if b.kind == "row":
            entries.append(F.when(b.fails, error_struct(b, fields)))
        elif b.kind == "unique":
            df = flag_duplicates(df, b.rule.fields, f"__dup{i}", b.rule.filter)
            flags.append(f"__dup{i}")
            entries.append(F.when(F.col(f"__dup{i}"), error_struct(b, fields)))
    errors = F.array_compact(F.array(*entries)) if entries else F.array().cast(ERROR_TYPE)
    return df.withColumn(ERRORS, errors).drop(*flags)


def split(annotated: DataFrame, persist: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, as they were, and rows with. persist keeps the annotated rows for the second of two writes."""
    if persist:
        annotated = annotated.persist()
    return annotated.where(F.size(ERRORS) == 0).drop(ERRORS), annotated.where(F.size(ERRORS) > 0)
