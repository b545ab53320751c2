"""Verdicts and split from the job that writes, and flags of duplicates within bounds of bytes."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tamis import RuleDefinition as R
from tamis import validate
from tamis.operators import bifurcate
from tamis.operators.bifurcate import flag_duplicates
from tamis.operators.observed import validate_and_write

RULES = [
    R("n", "is_less_than", 3), R("n", "is_unique", threshold=0.2), R("s", "is_legit", threshold=0.3), R("s", "is_in", ["a"], filter="n > 1"), R("n,s", "are_unique"), R("n", "has_mean", 2, 0.5), R("s", "has_cardinality", 3, 0.1),
    R("n", "has_max", 4, 0, filter="s = 'a'"), R("s", "has_entropy", 1, 0.2), R("*", "satisfies", "cast(s AS int) > 1"), R("gone", "is_complete"), R("n", "has_cardinality", 4, 0.3, filter="s = 'a'"),
]


def figures(report):
    return [(r.rule_id, r.status, r.fail_count, r.total_rows, r.actual) for r in report]


def rows_of(df):
    return sorted((str(r["n"]), str(r["s"]), tuple(e["rule_id"] for e in r["_dq_errors"]) if "_dq_errors" in r else ()) for r in df.collect())


@pytest.mark.parametrize(("seed", "rows"), [(1, 60), (2, 0)])
def test_one_pass_equals_two(spark, tmp_path, seed, rows):
    draw = random.Random(seed)
    df = spark.createDataFrame([(draw.choice([None, *range(5)]), draw.choice([None, "a", "b", ""])) for _ in range(rows)], "n int, s string")
    wanted = validate(df, RULES)
    out = validate_and_write(df, RULES, str(tmp_path / "out"))
    assert figures(out.report) == figures(wanted) and out.report[9].status.value == ("ERROR" if rows else "PASS")
    good, bad = wanted.split()
    assert rows_of(out.good) == rows_of(good) and rows_of(out.bad) == rows_of(bad) and out.good.columns == df.columns


def test_one_job_with_one_scan(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    rules = [R("o_totalprice", "is_between", [1000, 200000]), R("o_orderstatus", "is_in", ["F"], 0.1), R("o_totalprice", "has_mean", 1, 0), R("o_totalprice", "has_std", 1, 0)]
    spark.sparkContext.setJobGroup("observed", "observed")
    try:
        out = validate_and_write(df, rules, str(tmp_path / "out"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # The job that writes, and the one that lists the folders of what was written.
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("observed")
    stages = [s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    assert len(jobs) <= 2 and len(stages) <= 2
    assert [r.status.value for r in out.report] == ["FAIL", "PASS", "FAIL", "FAIL"] and out.good.count() + out.bad.count() == df.count() == out.report.total_rows


def test_a_fault_of_the_table(spark, tmp_path):
    with pytest.raises(Exception, match="assert|false|USER_RAISED"):
        validate_and_write(spark.range(3).where("assert_true(id < 0) is null"), [R("id", "is_positive")], str(tmp_path / "x"))


def by_window(df, keys, where=None):
    held = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    own = Window.partitionBy(*keys, held)
    return sorted((r["i"], r["again"]) for r in df.withColumn("again", held & (F.count(F.lit(1)).over(own) > 1)).collect())


@pytest.mark.parametrize("bounds", [(64 << 20, 10_000), (0, 10), (0, 1 << 30)])
@pytest.mark.parametrize("keys", [["n"], ["n", "s"], ["x"], ["a"]])
def test_duplicate_flags(spark, monkeypatch, bounds, keys):
    monkeypatch.setattr(bifurcate, "BROADCAST_BYTES", bounds[0])
    monkeypatch.setattr(bifurcate, "HOT_KEYS", bounds[1])
    draw = random.Random(3)
    rows = [(i, draw.choice([None, 1, *range(40)]), draw.choice([None, "", "-", "1:a"]), draw.choice([0.0, -0.0, float("nan"), None, draw.random()]), draw.choice([[1], [], None, [i]])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, n int, s string, x double, a array<int>").repartition(3)
    for where in (None, "i > 7"):
        assert sorted((r["i"], r["again"]) for r in flag_duplicates(df, keys, "again", where).collect()) == by_window(df, keys, where)


def test_many_wide_repeated_keys(spark, monkeypatch):
    """Keys of 1 kB, one with half of the rows, more of them than may be broadcast: what moves is bounded, and no task gets the hot key's rows."""
    monkeypatch.setattr(bifurcate, "BROADCAST_BYTES", 1 << 20)
    n, seen = 200_000, []
    real = bifurcate.materialise
    monkeypatch.setattr(bifurcate, "materialise", lambda df, name, *by: seen.append((name, real(df, name, *by))) or seen[-1][1])
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 5 == 0, F.col("id").cast("string")).otherwise((F.col("id") % 50_000).cast("string"))
    df = spark.range(n).select(F.col("id").alias("i"), F.rpad(key, 1000, "x").alias("k"))
    flagged = flag_duplicates(df, ["k"], "again")
    tables = dict(seen)
    bitmap = tables["dq-bitmap"].agg(F.sum(F.length("__m"))).first()[0]
    assert bitmap <= 16 * 25_000 / 8 + 4096
    truth = df.join(df.groupBy("k").agg((F.count(F.lit(1)) > 1).alias("truth")), "k")
    assert flagged.join(truth, "i").where("again <> truth").count() == 0 and flagged.count() == n
    # Rows that are dealt by key: none of a frequent one, and of those that are alone only a few.
    repeated = tables["dq-repeated"]
    assert repeated.where(F.col("__n") > n // 20).count() == 1
    size, most = repeated.agg(F.count(F.lit(1)), F.sum("__n")).first()
    moved = bifurcate._told(df.withColumn("__k", bifurcate.key_id(df, ["k"])), repeated, size, most).where("__moves")
    per_key = moved.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count_if(F.col("n") == 1)).first()
    assert per_key[0] <= n // 20 and per_key[1] <= 0.2 * 20_000
