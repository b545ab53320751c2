"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is target weight * budget / its bytes. Each document draws its number of copies from a Poisson
distribution with that mean: a hash of seed and id is a uniform number, and the distribution function is inverted at it.
So a draw needs no state, is the same after a retry, and a source's bytes come to its target in the mean. Documents are
exploded by their count and shuffled globally by a seeded key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HASH_BITS, hash52, join_groups, materialise

#: Rates above this are drawn as sums of that many equal parts, each with a hash of its own; exp(-rate) never underflows.
PART = 16.0
#: Sources whose distributions, some 200 bytes each, are broadcast.
MOST_SOURCES = 20_000


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k from 0, for X Poisson of the given mean, at most PART, as far as it is below 1; for a rate of 0 nothing."""
    # The probability beyond 79 is under 1e-30 for means up to 16, below the grain of a double.
    first = F.exp(-rate)

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(79)), F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")), step)["all"]
    return F.array_distinct(F.filter(found, lambda c: c < 1))


def poisson(u: Column, rate: Column) -> Column:
    """The smallest k with P(X <= k) > u for X Poisson of the given mean, at most PART; 0 for a rate of 0."""
    return draws(F.array(u), cumulative(rate))


def draws(uniform: Column, cdf: Column) -> Column:
    """The sum of the distribution inverted at each of the uniform numbers, an array, which is computed once."""
    return F.aggregate(uniform, F.lit(0), lambda s, u: s + F.size(F.filter(cdf, lambda c: c <= u)))


def rates(docs: DataFrame, weights: Mapping[str, float] | None, power: float, epochs: float, text_col: str, source_col: str) -> DataFrame:
    """One row for each source: __stratum, __rows, __rate (target weight * epochs * all bytes / bytes of the source), the __parts that
    it is drawn in, and the distribution __cdf of a part.

    Without weights, a source's target is in proportion to its bytes ** power (1: as it is, 0: all alike). With weights, sources
    that aren't named get none; the weights are normalised over the sources that are there.
    """
    sizes = docs.groupBy(stratum(source_col)).agg(F.count(F.lit(1)).alias("__rows"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 1).alias("__bytes"))
    if weights is None:
        sizes = sizes.withColumn("__w", F.pow(F.col("__bytes").cast("double"), F.lit(float(power))))
    else:
        given = docs.sparkSession.createDataFrame([("+" + k, float(v)) for k, v in weights.items()], "__stratum string, __w double")
        sizes = sizes.join(given, "__stratum", "left").withColumn("__w", F.coalesce("__w", F.lit(0.0)))
    sizes = materialise(sizes, "mix-sizes")
    total = sizes.agg(F.sum("__w").alias("__ws"), F.sum("__bytes").alias("__all"))
    share = F.when(F.col("__ws") > 0, F.col("__w") / F.col("__ws")).otherwise(F.lit(0.0))
    rated = sizes.join(F.broadcast(total)).select("__stratum", "__rows", (share * F.lit(float(epochs)) * F.col("__all") / F.col("__bytes")).alias("__rate"))
    rated = rated.withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__rate") / PART)).cast("int"))
    return materialise(rated.withColumn("__cdf", cumulative(F.col("__rate") / F.col("__parts"))), "mix-rates")


def stratum(source_col: str) -> Column:
    """The source with a mark before it, so that null is a source of its own."""
    return F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("__stratum")


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with one row per copy, shuffled globally, and three columns more: rate, copies (the draw) and copy (from 0).

    A copy's place is its shuffle key, hash of seed, id and copy. Documents that draw 0 have no row. Rows with a null id draw by
    their text. Repeated rows draw alike. Columns of these three names in docs are replaced. An empty table gives no rows.
    """
    base = [c for c in docs.columns if c not in ("rate", "copies", "copy")]
    who = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    sources = rates(docs, weights, power, epochs, text_col, source_col)
    total = sources.agg(F.sum("__rows")).first()[0] or 0
    rows = join_groups(docs.select(*(F.col(f"`{c}`") for c in base), stratum(source_col)), sources, "__stratum", "__rows", total, MOST_SOURCES).withColumn("__who", who)
    uniform = F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), lambda part: hash52(seed, F.col("__who"), part) / F.lit(float(1 << HASH_BITS)))
    rows = rows.withColumn("copies", draws(uniform, F.col("__cdf")))
    copies = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copies = copies.withColumn("__key", hash52(f"{seed}-order", F.col("__who"), F.col("copy"))).withColumnRenamed("__rate", "rate")
    # The key is uniform, so ranges of equal length hold about as many rows: no pass that samples is needed.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = copies.repartitionById(n, F.least(F.floor(F.col("__key") / F.lit((1 << HASH_BITS) / n)), F.lit(n - 1)).cast("int"))
    return laid.sortWithinPartitions("__key").select(*(F.col(f"`{c}`") for c in base), "rate", "copies", "copy", F.col("__key").alias("shuffle_key"))
