"""Sharding, exact dedup, mixing: op3, op5, op9."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import same_rows
from odd_rows import docs, odd  # noqa: F401

from tamis.llm import common, exact_dedup, mixing, sharding
from tamis.llm.queries import ORACLES, QUERIES
from tamis.sources import scratch


def check_shards(rows, expected, shards):
    assert len(rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for source, n in Counter(r.source for r in rows).items():
        for s in range(shards):
            assert abs(sum(r.source == source for r in by[s]) - n / shards) < 2


@pytest.mark.parametrize("bucket_rows", [7, 50_000])
def test_shards(docs, bucket_rows):
    rows = sharding.interleave(docs, 8, bucket_rows=bucket_rows).collect()
    check_shards(rows, docs.count(), 8)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_shards_do_not_depend_on_buckets_or_row_order(docs):
    a = sharding.interleave(docs, 8, bucket_rows=9).select("doc_id", "shard", "slot")
    b = sharding.interleave(docs.orderBy("text").repartition(5), 8).select("doc_id", "shard", "slot")
    assert a.exceptAll(b).count() == 0


def test_shards_of_odd_rows(odd):
    rows = sharding.interleave(odd, 3, bucket_rows=3).collect()
    check_shards(rows, odd.count(), 3)
    assert sharding.interleave(odd.where("doc_id < 0"), 3).count() == 0
    assert sorted(r.shard for r in sharding.interleave(odd.where("doc_id = 1"), 8).collect()) == [0]


def test_op3_query(spark, sf):
    out = QUERIES["op3_interleave"](spark, sf)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check_shards(out.collect(), spark.read.parquet(f"{sf}/documents.parquet").count(), 8)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, i, r.doc_id))
    out = Counter()
    for text, own in groups.items():
        best = min(own)
        for x in own:
            out[x[4], best[4], len(own), hashlib.sha256(text.encode()).hexdigest()] += 1
    return out, len(groups)


@pytest.mark.parametrize("max_bits", [32_768, exact_dedup.MAX_BITS])
def test_exact_dedup(odd, docs, max_bits):
    for df in (odd, docs):
        rows = exact_dedup.report(df, max_bits=max_bits).collect()
        wanted, groups = brute_exact(df.collect())
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == wanted
        assert sum(r.kept for r in rows) == groups and all(r.doc_id == r.keep_id for r in rows if r.kept)
        kept = exact_dedup.drop_copies(df, max_bits=max_bits)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    assert exact_dedup.report(odd.where("doc_id < 0")).count() == exact_dedup.drop_copies(odd.where("doc_id < 0")).count() == 0


def test_filter_in_parts_does_not_fill(spark):
    """Far more keys than one filter's bits: most rows that are alone still go straight through."""
    df = spark.range(70_000).selectExpr("id AS doc_id", "concat('t', id % 69000) AS text")
    rows = exact_dedup.report(df, max_bits=131_072)
    assert rows.where("kept").count() == 69_000 and rows.where("group_size = 2").count() == 2000
    keys = df.select(exact_dedup.text_key(df.text).alias("k"))
    marked = exact_dedup.possibly_repeated(keys, keys, "k", 131_072)
    assert marked.count() == 70_000 and 2000 <= marked.where("__repeated").count() < 5000
    kept = exact_dedup.drop_copies(df, max_bits=131_072)
    assert kept.count() == 69_000 and kept.selectExpr("max(doc_id)").first()[0] == 68_999


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "xy"), ("c", "x  y"), (None, "x  y"), ("d", "z")], "doc_id string, text string")
    rows = sorted(map(tuple, exact_dedup.report(df).select("doc_id", "keep_id", "kept").collect()), key=str)
    assert rows == sorted([("b", "c", False), ("a", "c", False), ("c", "c", True), (None, "c", False), ("d", "d", True)], key=str)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == ["c", "d"]


def test_rows_that_are_alone_are_not_grouped(docs):
    keys = docs.select(exact_dedup.text_key(docs.text).alias("k"))
    marked = exact_dedup.possibly_repeated(keys, keys, "k")
    counts = Counter(r.k for r in keys.collect())
    flagged = [r.k for r in marked.where("__repeated").collect()]
    assert {k for k, n in counts.items() if n > 1} <= set(flagged) and len(flagged) < 0.3 * len(counts)


def test_poisson_inverts_the_distribution(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000).selectExpr("(id + 0.5) / 2000 AS u")
    for rate in (0.0, 0.3, 4.0, 16.0):
        got = [r.k for r in df.select("u", mixing.poisson(F.col("u"), F.lit(rate)).alias("k")).orderBy("u").collect()]
        wanted, k, p, c = [], 0, math.exp(-rate), math.exp(-rate)
        for i in range(2000):
            while (i + 0.5) / 2000 >= c:
                k += 1
                p *= rate / k
                c += p
            wanted.append(k)
        assert got == wanted


def test_mixing_reaches_weights(spark):
    df = spark.range(40_000).selectExpr("id AS doc_id", "'0123456789' AS text", "if(id % 10 = 0, 'rare', 'common') AS source", "'x' AS copy")
    out = mixing.replicate(df, {"rare": 3.0, "common": 1.0, "absent": 5.0}, epochs=1.5)
    assert out.columns == ["doc_id", "text", "source", "rate", "copies", "copy", "shuffle_key"]
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["rare"] / 45_000 - 1) < 0.03 and abs(n["common"] / 15_000 - 1) < 0.03
    rates = {r.source: r.rate for r in out.select("source", "rate").distinct().collect()}
    assert abs(rates["rare"] - 11.25) < 1e-9
    assert mixing.replicate(df, {"rare": 1.0}, epochs=40.0).where("source = 'common'").count() == 0
    big = mixing.replicate(df.where("source = 'rare'"), {"rare": 1.0}, epochs=100.0)  # a mean far above one part
    assert abs(big.count() / 400_000 - 1) < 0.02
    keys = [r.shuffle_key for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_mixing_of_odd_rows(odd):
    out = mixing.replicate(odd, epochs=3.0)
    assert out.columns == [*odd.columns, "rate", "copies", "copy", "shuffle_key"]
    rows = out.collect()
    assert all(0 <= r.copy < r.copies for r in rows) and {r.source for r in rows} <= {"a", "b", "c", None}
    assert mixing.replicate(odd.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", ["op5_bloom_dedup", "op9_poisson_mix"])
def test_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["op3_interleave", "op5_bloom_dedup"])
def test_native(spark, sf, name, monkeypatch):
    """No plan of the query, those of its scratch tables included, runs Python."""
    plans = []

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return scratch.materialise(df, *rest)

    for module in (exact_dedup, sharding, common):
        monkeypatch.setattr(module, "materialise", seen)
    plans.append(QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 3 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


def test_shards_equal_a_brute_force(docs):
    """Every row's fraction, shard and slot, from ranks and phases by the definition."""
    def hash52(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)

    sources, wanted = defaultdict(list), []
    for r in docs.collect():
        sources[r.source].append((hash52("shards", r.doc_id), r.doc_id))
    for source, own in sources.items():
        phase = (hash52("shards-phase", f"+{source}") + 0.5) / 2**52
        wanted += [((rank - phase) / len(own), f"+{source}", h, d) for rank, (h, d) in enumerate(sorted(own), 1)]
    n, by = len(wanted), Counter()
    got = {r.doc_id: r for r in sharding.interleave(docs, 8, bucket_rows=11).collect()}
    for at, (fraction, _, _, d) in enumerate(sorted(wanted)):
        shard = at * 8 // n
        assert (got[d].shard, got[d].slot) == (shard, by[shard]) and math.isclose(got[d].fraction, fraction, rel_tol=1e-12)
        by[shard] += 1
