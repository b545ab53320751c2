"""Guarded streams, sinks that commit together, states that add up."""

import random

import pytest
from pyspark.sql import functions as F

from tamis import RuleDefinition as R
from tamis import validate, validate_stream
from tamis.functions.predicates import TABLE_RULES, register_table_rule
from tamis.operators.metric_states import metric_states, sketch_size
from tamis.plans.planner import bind
from tamis.rules import MANIFEST
from tamis.sources.store import names, read_json, write_json
from tamis.streaming.stream import read_committed

THROWS = R("*", "satisfies", "cast(s AS int) > 5")
GOOD = [R("n", "is_less_than", 50), R("s", "is_complete")]


def stream_of(spark, folder):
    return spark.readStream.schema("n int, s string").parquet(folder)


def put(spark, folder, rows):
    spark.createDataFrame(rows, "n int, s string").coalesce(1).write.mode("append").parquet(folder)


def run(checked, tmp_path, name=""):
    query = checked.write(*(str(tmp_path / f"{x}{name}") for x in ("good", "bad", "state")))
    query.awaitTermination()


def test_a_rule_that_throws_is_switched_off(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    put(spark, source, [(1, "7"), (60, "8"), (2, "3")])
    first = validate_stream(stream_of(spark, source), [GOOD[0], THROWS, GOOD[1]])
    run(first, tmp_path)
    assert first.errors == []  # nothing has thrown yet
    put(spark, source, [(3, "x"), (70, None)])
    run(first, tmp_path)
    assert [(e.rule_id, e.status.value) for e in first.errors] == [(first.plan.bound[1].rule_id, "ERROR")] and "CAST_INVALID_INPUT" in first.errors[0].message
    # After a restart with the same checkpoint the rule stays off; a mended one is tried again.
    again = validate_stream(stream_of(spark, source), [GOOD[0], THROWS, GOOD[1]])
    put(spark, source, [(4, "4"), (80, "9")])
    run(again, tmp_path)
    assert len(again.errors) == 1
    mended = validate_stream(stream_of(spark, source), [GOOD[0], R("*", "satisfies", "try_cast(s AS int) > 5"), GOOD[1]])
    put(spark, source, [(5, "4"), (6, "9")])
    run(mended, tmp_path)
    assert mended.errors == []
    good, bad = (read_committed(spark, str(tmp_path / x), state) for x in ("good", "bad"))
    assert sorted((r["batch"], r["n"]) for r in good.collect()) == [(0, 1), (1, 3), (2, 4), (3, 6)]
    assert sorted((r["batch"], r["n"], tuple(e["check_type"] for e in r["_dq_errors"])) for r in bad.collect()) == [
        (0, 2, ("satisfies",)), (0, 60, ("is_less_than",)), (1, 70, ("is_less_than", "is_complete")), (2, 80, ("is_less_than",)), (3, 5, ("satisfies",)),
    ]


def test_several_throwing_rules(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, [(i, "x") for i in range(9)])
    checked = validate_stream(stream_of(spark, source), [THROWS, GOOD[0], R("*", "satisfies", "1 / (n - n) > 0"), GOOD[1], R("n", "is_positive", filter="cast(s AS int) > 1")])
    run(checked, tmp_path)
    assert sorted(e.rule_id[0] for e in checked.errors) == ["0", "2", "4"]
    assert spark.read.parquet(str(tmp_path / "good")).count() == 9


def test_a_fault_of_the_source_stops_the_stream(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [(1, "x")])
    broken = stream_of(spark, str(tmp_path / "in")).where("assert_true(n < 0) is null")
    with pytest.raises(Exception, match="USER_RAISED|assert|false"):
        run(validate_stream(broken, GOOD), tmp_path)


def test_both_sinks_or_none(spark, tmp_path):
    """A failure between the two writes: the batch is in no reader's view, and comes whole after a new start."""
    source, good, bad, state = (str(tmp_path / x) for x in ("in", "good", "bad", "state"))
    put(spark, source, [(1, "a"), (60, "b")])
    checked = validate_stream(stream_of(spark, source), GOOD)
    checked.write(good, bad, state).awaitTermination()
    put(spark, source, [(2, "a"), (61, "b")])

    def fails(good_rows, bad_rows, number):
        good_rows.write.mode("overwrite").parquet(f"{good}/batch={number}")
        raise RuntimeError("between the writes")

    with pytest.raises(Exception, match="between the writes"):
        checked.for_each(fails, state).awaitTermination()
    assert spark.read.parquet(good).count() == 2 and read_committed(spark, good, state).count() == 1
    seen = []
    validate_stream(stream_of(spark, source), GOOD).write(good, bad, state).awaitTermination()
    checked.for_each(lambda g, b, n: seen.append(n), state).awaitTermination()
    assert seen == []
    assert sorted(r["n"] for r in read_committed(spark, good, state).collect()) == [1, 2] and sorted(r["n"] for r in read_committed(spark, bad, state).collect()) == [60, 61]


def test_totals_of_a_stream(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    rules = [R("n", "has_mean", 3, 0.5), R("n", "is_unique"), R("s", "has_entropy", 1, 0.2), GOOD[0], R("n", "has_max", 100, 0, filter="cast(s AS int) > 1"), R("*", "validate_schema", {"columns": []})]
    batches = [[(1, "1"), (2, "2")], [(2, "2"), (9, None)], [(4, "x"), (70, "1")]]
    reports = []
    for rows in batches:
        put(spark, source, rows)
        checked = validate_stream(stream_of(spark, source), rules, totals=True)
        run(checked, tmp_path)
        reports.append(checked.report(spark, state))
    whole = validate(spark.createDataFrame(sum(batches, []), "n int, s string"), rules[:4])
    assert [(r.status, r.fail_count, r.total_rows) for r in reports[-1]][:4] == [(r.status, r.fail_count, r.total_rows) for r in whole]
    assert reports[-1][0].actual == pytest.approx(whole[0].actual) and reports[-1][2].actual == pytest.approx(whole[2].actual)
    assert reports[1][4].status.value == "FAIL" and [e.rule_id[0] for e in checked.errors] == ["5", "4"]  # a schema has no state; the filter threw in the last batch
    first = checked.report(spark, state, batch=0)
    assert first.total_rows == 2 and first[1].fail_count == 0 and reports[1][1].fail_count == 2


RULES = [
    R("x", "has_mean", 1, 0.1), R("x", "has_std", 1, 0.1), R("x", "has_min", 0, 0), R("x", "has_max", 9, 0), R("k", "has_sum", 5, 0), R("k", "has_cardinality", 5, 0), R("t", "has_min", "2024-01-01", 0), R("g", "has_max", "z", 0),
    R("g", "has_entropy", 1, 0.1), R("g,k", "has_infogain", 1, 0.1), R("k", "is_unique"), R("k,g", "are_unique"), R("x", "is_positive"), R("x", "has_mean", 1, 0.1, filter="k > 3"), R("g", "is_in", ["a"], filter="k > 3"),
    R("k", "is_unique", filter="g = 'a'"), R("d", "has_sum", 1, 0), R("gone", "is_complete"), R("g", "has_mean", 1, 0),
]


def random_table(spark, seed, rows):
    draw = random.Random(seed)
    data = [(draw.choice([None, draw.gauss(1e6, 1), 0.0, -0.0]), draw.choice([None, *range(7)]), draw.choice([None, "a", "b", ""]), draw.choice([None, "2024-01-0" + draw.choice("12345")]), draw.randint(0, 3)) for _ in range(rows)]
    return spark.createDataFrame(data, "x double, k int, g string, t string, part int").withColumn("t", F.col("t").cast("date")).withColumn("d", F.col("x").cast("decimal(20,3)"))


def figures(report):
    return [(r.status, r.fail_count, r.total_rows, round(r.actual, 6) if isinstance(r.actual, float) else r.actual) for r in report]


@pytest.mark.parametrize(("seed", "rows"), [(1, 200), (2, 3), (4, 0)])
def test_states_add_up(spark, seed, rows):
    df = random_table(spark, seed, rows).cache()
    wanted = figures(validate(df, RULES))
    plan = bind(df, RULES)
    if rows > 100:
        assert figures(metric_states(plan).report()) == wanted
        parts = [metric_states(plan.over(df.where(F.col("part") == p))) for p in range(3)] + [metric_states(plan.over(df.where("part = 3")))]
        assert figures(parts[3].merge(parts[1]).merge(parts[0].merge(parts[2])).report()) == wanted
    two = metric_states(plan, by=["part", "g"]).merge(by=["part"])
    assert two.totals.count() == df.select("part").distinct().count() and figures(two.report()) == wanted


def test_stored_states(spark, tmp_path):
    df = random_table(spark, 5, 100)
    for p in range(2):
        metric_states(bind(df.where(F.col("part") % 2 == p), RULES)).write(str(tmp_path / f"p{p}"))
    read = metric_states(bind(df.where("false"), RULES)).read(str(tmp_path / "p0"), str(tmp_path / "p1"))
    assert figures(read.report()) == figures(validate(df, RULES))


def test_sketches(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("k"), (F.col("id") % 7).alias("part"))
    rule = R("k", "has_cardinality", 5000, 0.05)
    states = metric_states(bind(df, [rule]), by=["part"], rsd=0.01)
    assert states.counts is None and states.report()[0].status.value == "PASS" and sketch_size(0.01) == 14 and sketch_size(0.5) == 4


def test_table_rules_of_ones_own(spark):
    df = spark.createDataFrame([(1.0, 1), (4.0, 3), (None, 5)], "x double, w int")
    register_table_rule("has_total_weight", lambda ctx, rule, rows: F.sum(F.when(rows, F.col("w"))))
    register_table_rule("has_range", lambda ctx, rule, rows: F.max("x") - F.min("x"), lambda actual, rule: actual < 4)
    register_table_rule("has_fault", lambda ctx, rule, rows: F.sum("w"), lambda actual, rule: 1 / 0)
    try:
        rules = [R("w", "has_total_weight", 9, 0), R("w", "has_total_weight", 8, 0, filter="w > 1"), R("w", "has_total_weight"), R("x", "has_range"), R("gone", "has_range"), R("w", "has_fault", 1), R("x", "has_mean", 2.5, 0)]
        plan = bind(df, rules)
        assert plan.metrics()._jdf.queryExecution().analyzed().toString().count("Aggregate") == 1
        assert [r.status.value for r in validate(df, rules)] == ["PASS", "PASS", "ERROR", "PASS", "ERROR", "ERROR", "PASS"]
        assert metric_states(plan).report()[0].status.value == "ERROR"
    finally:
        for name in ("has_total_weight", "has_range", "has_fault"):
            MANIFEST.pop(name)
            TABLE_RULES.pop(name)


def test_json_files(spark, tmp_path):
    path = str(tmp_path / "a" / "b")
    assert read_json(spark, path, 7) == 7 and names(spark, str(tmp_path / "none")) == []
    write_json(spark, path, {"x": "é"})
    write_json(spark, path, {"x": 2})
    assert read_json(spark, path) == {"x": 2} and names(spark, str(tmp_path / "a")) == ["b"]
