from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis import RuleDefinition as R
from tamis import ValidationStatus, list_rules, register_rule, validate
from tamis.functions.predicates import java_pattern
from tamis.plans.planner import bind
from tamis.rules import MANIFEST

DAY = date(2024, 3, 13)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a@x.io", 17, "active", 500.0, "US", "  "), (2, None, 25, "banned", 2e6, "US", None), (2, "b@x.io", 60, "active", 3e9, "BR", "ok"), (4, "bad", None, None, -1.0, "XX", "\t\n")]
    return spark.createDataFrame(rows, "id bigint, email string, age bigint, status string, revenue double, country string, note string").cache()


@pytest.fixture(scope="module")
def dates(spark):
    rows = [(DAY, "2024-03-13"), (DAY - timedelta(1), "2024-03-12"), (DAY - timedelta(2), "not-a-date"), (DAY + timedelta(5), "2099-01-01"), (None, None)]
    return spark.createDataFrame(rows, "d date, s string").cache()


def fails(df, rule, **options):
    r = validate(df, [rule], **options)[0]
    assert r.status is not ValidationStatus.ERROR, r.message
    return r.fail_count


@pytest.mark.parametrize(
    ("rule", "count"),
    [
        (R("email", "is_complete"), 1), (R("email,age", "are_complete"), 2), (R("id", "is_unique"), 2), (R("id", "is_primary_key"), 2), (R("id,country", "are_unique"), 0), (R("id,country", "is_composite_key"), 0),
        (R("age", "is_equal", 25), 2), (R("status", "is_equal", "active"), 1), (R("id", "is_equal_than", "age"), 3), (R("age", "is_between", [18, 60]), 1), (R("age", "is_greater_than", 17), 1),
        (R("age", "is_less_than", 60), 1), (R("age", "is_greater_or_equal_than", 18), 1), (R("age", "is_less_or_equal_than", 25), 1), (R("revenue", "is_positive"), 1), (R("revenue", "is_negative"), 3),
        (R("revenue", "is_in_millions"), 2), (R("revenue", "is_in_billions"), 3), (R("country", "is_in", ["US", "BR"]), 1), (R("country", "is_contained_in", ["US"]), 2), (R("status", "not_in", ["banned"]), 1),
        (R("status", "not_contained_in", ["active"]), 2), (R("email", "has_pattern", "@x"), 1), (R("note", "is_legit"), 3), (R("*", "satisfies", "age >= 18 AND status != 'banned'"), 2), (R("note", "is_greater_than", 1), 0),
    ],
)
def test_row_checks(people, rule, count):
    assert fails(people, rule) == count


@pytest.mark.parametrize(
    ("check", "value", "count"),
    [
        ("is_today", None, 3), ("is_yesterday", None, 3), ("is_t_minus_1", None, 3), ("is_t_minus_2", None, 3), ("is_t_minus_3", None, 4), ("is_past_date", None, 2), ("is_future_date", None, 3),
        ("is_date_between", ["2024-03-12", DAY], 2), ("is_date_after", DAY, 3), ("is_date_before", "2024-03-13", 2), ("is_on_weekday", None, 0), ("is_on_weekend", None, 4), ("is_on_monday", None, 2 + 1),
        ("is_on_tuesday", None, 3), ("is_on_wednesday", None, 3), ("is_on_thursday", None, 4), ("is_on_friday", None, 4), ("is_on_saturday", None, 4), ("is_on_sunday", None, 4),
    ],
)
def test_date_checks(dates, check, value, count):
    # 13 March 2024 is a Wednesday; five days later is a Monday.
    if check == "is_on_monday":
        count = 2
    assert fails(dates, R("d", check, value), as_of=DAY) == count


def test_date_texts(dates):
    assert fails(dates, R("s", "validate_date_format")) == 1
    assert fails(dates, R("s", "validate_date_format", "%Y-%m-%d")) == 1
    assert fails(dates, R("s", "validate_date_format", "%d/%m/%Y")) == 4
    assert fails(dates, R("s", "all_date_checks"), as_of=DAY) == 2
    assert fails(dates, R("s", "is_past_date"), as_of=DAY) == 2  # text that is no date can't be judged
    assert fails(dates, R("s", "is_past_date"), as_of=DAY, null_policy="fail") == 4
    assert java_pattern("%d de %B, %H:%M") == "dd' de 'MMMM, HH:mm"


def test_null_policy(people):
    rule = R("status", "is_in", ["active"])
    assert fails(people, rule) == 1 and fails(people, rule, null_policy="fail") == 2
    assert fails(people, R("note", "is_legit"), null_policy="fail") == 3


@pytest.mark.parametrize(
    ("rule", "status"),
    [
        (R("age", "has_min", 17, 0.0), "PASS"), (R("age", "has_max", 61, 0.05), "PASS"), (R("age", "has_max", 61, 0.0), "FAIL"), (R("age", "has_sum", 102, 0), "PASS"), (R("age", "has_mean", 34, 0.01), "PASS"),
        (R("age", "has_std", 22.87, 0.01), "PASS"), (R("country", "has_cardinality", 3, 0), "PASS"), (R("revenue", "has_min", -1, 0.1), "PASS"), (R("revenue", "has_min", -2, 0.1), "FAIL"), (R("age", "has_sum"), "ERROR"),
        (R("country", "has_entropy", 1.5, 0.01), "PASS"), (R("country,status", "has_infogain", 0.0, 0.1), "FAIL"), (R("id", "has_min", 0, 0.5), "FAIL"),
    ],
)
def test_table_checks(people, rule, status):
    assert validate(people, [rule])[0].status.value == status


def test_many_exact_cardinalities(people):
    report = validate(people, [R(c, "has_cardinality", n, 0.0) for c, n in (("id", 3), ("email", 3), ("age", 3), ("status", 2), ("country", 3), ("note", 3), ("revenue", 4))])
    assert report.pass_rate == 1


def test_entropy_of_the_fixture(spark):
    df = spark.createDataFrame([(c,) for c in "AABBC"], "c string")
    r = validate(df, [R("c", "has_entropy", 1.5, 0.2)])[0]
    assert r.status is ValidationStatus.PASS and abs(r.actual - 1.5219) < 1e-4


def test_information_gain(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "b"), (None, "c")], "x int, y string")
    assert abs(validate(df, [R("x,y", "has_infogain", 1.0, 0.0)])[0].actual - 1.0) < 1e-12


def test_errors_disturb_nothing(people):
    rules = [R("nope", "is_complete"), R("age", "is_between", 5), R("age", "is_in", 5), R("email", "has_pattern"), R("id", "is_complete", execute=False), R("country", "is_today"), R("id", "is_complete")]
    report = validate(people, rules)
    assert [r.status.value for r in report] == ["ERROR"] * 5 + ["PASS"] * 2
    assert report[4].message == "Skipped: execute=False" and "nope" in report[0].message
    assert report.pass_rate == 2 / 7 and len(report.errors) == 5 and len(report) == 7


@pytest.mark.parametrize(
    "rule",
    [
        R("*", "satisfies", "nope > 1"), R("*", "satisfies", "age >"), R("*", "satisfies", "age"), R("*", "satisfies", "cast(email AS int) > 1"), R("email", "has_pattern", "("), R("tags", "is_equal", 1),
        R("tags", "has_mean", 1, 0.1), R("age", "is_positive", filter="nope = 1"), R("tags", "is_equal_than", "age"), R("age", "is_positive", filter="cast(email AS int) > 1"), R("age", "validate_schema", {"columns": 7}),
        R("*", "satisfies", "1 / (id - id) > 0"), R("age,email", "has_infogain", 1.0, 0.1, filter="age +"), R("tags", "is_between", [1, 2]), R("tags", "is_on_weekday"), R("age", "has_entropy", "x", 0.1),
    ],
    ids=lambda r: f"{r.check_type}-{str(r.value)[:12]}-{str(r.filter)[:8]}",
)
def test_one_bad_rule_disturbs_no_other(people, rule):
    df = people.withColumn("tags", F.array("email"))
    good = [R("id", "is_complete"), R("country", "is_in", ["US"]), R("age", "has_max", 60, 0.0), R("id", "is_unique")]
    wanted = [(r.status, r.fail_count, r.actual) for r in validate(df, good)]
    report = validate(df, [*good[:2], rule, *good[2:]])
    got = [(r.status, r.fail_count, r.actual) for r in report]
    assert got[:2] + got[3:] == wanted
    assert report[2].status is (ValidationStatus.FAIL if rule.check_type == "has_entropy" else ValidationStatus.ERROR) and (report[2].message or "").startswith(("Error: ", "Expected"))
    good_rows, bad_rows = report.split()
    assert good_rows.count() + bad_rows.count() == 4


def test_several_rules_that_fail_on_the_data(people):
    bad = R("*", "satisfies", "cast(email AS int) > 1")
    report = validate(people, [bad, R("id", "is_complete"), bad, R("age", "has_max", 60, 0.0), bad, bad, R("email", "is_complete")])
    assert [r.status.value for r in report] == ["ERROR", "PASS", "ERROR", "PASS", "ERROR", "ERROR", "FAIL"] and report.total_rows == 4
    assert [r.status.value for r in validate(people, [bad])] == ["ERROR"]


def test_a_table_that_cannot_be_read_is_no_rules_fault(people):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        validate(people.where("assert_true(id < 0) is null"), [R("id", "is_complete")])


def test_empty_table(people):
    report = validate(people.where("id < 0"), [R("id", "is_complete"), R("id", "is_unique"), R("age", "has_min", 1), R("country", "has_entropy", 1)])
    assert [r.status.value for r in report] == ["PASS", "PASS", "FAIL", "FAIL"] and report.total_rows == 0


def test_one_action_for_any_number_of_rules(spark, people):
    """Row rules and aggregates are one scan; each set of keys is one more."""
    plan = bind(people, [R("age", "is_positive"), R("age", "has_sum", 1), R("id", "is_unique"), R("id", "has_entropy", 1), R("id", "is_primary_key")])
    text = plan.metrics()._jdf.queryExecution().analyzed().toString()
    assert text.count("Aggregate") == 3  # fused, grouping by id, its sum


def test_filters(people):
    assert fails(people, R("age", "is_greater_than", 20, filter="country = 'US'")) == 1
    r = validate(people, [R("age", "is_greater_than", 20, filter="country = 'US'"), R("age", "has_max", 25, 0, filter="country = 'US'"), R("id", "is_unique", filter="country = 'US'")])
    assert [x.total_rows for x in r] == [2, 2, 2] and [x.status.value for x in r] == ["FAIL", "PASS", "PASS"]
    assert validate(people, [R("age", "is_positive")], where="country = 'BR'").total_rows == 1


def test_custom_rule(people):
    register_rule("is_even", lambda ctx, rule: F.col(rule.fields[0]) % 2 != 0)
    try:
        assert fails(people, R("id", "is_even")) == 1
    finally:
        MANIFEST.pop("is_even")


def test_every_check_is_planned(people):
    values = {"is_equal_than": "id", "is_equal_to_column": "id", "is_between": [1, 2], "is_date_between": ["2024-01-01", "2024-01-02"], "is_date_after": DAY, "is_date_before": DAY, "has_pattern": "a", "satisfies": "1 = 1", "logic_check": "1 = 1"}
    for name in list_rules():
        group = MANIFEST[name].category
        field = "country,status" if name in ("has_infogain", "are_unique", "are_complete", "is_composite_key") else "country" if group == "date" else "age"
        value = values.get(name, ["1"] if group == "membership" else 1)
        bound = bind(people, [R(field, name, None if group == "date" and name not in values else value)]).bound[0]
        assert bound.error is None, (name, bound.error)


def test_split_is_a_disjoint_cover(people):
    rules = [R("country", "is_in", ["US", "BR"]), R("id", "is_unique"), R("age", "is_positive", threshold=0.5), R("email", "is_complete")]
    report = validate(people, rules)
    good, bad = report.split(persist=True)
    assert good.columns == people.columns and bad.count() == 3
    both = good.unionByName(bad.drop("_dq_errors"))
    assert both.exceptAll(people).count() == 0 and people.exceptAll(both).count() == 0
    found = {(r["id"], e["check_type"]) for r in bad.collect() for e in r["_dq_errors"]}
    assert found == {(2, "is_unique"), (2, "is_complete"), (4, "is_in")}
    assert report.get_bad_df().dtypes[-1][1].count(":string") == 8


def test_rules_that_pass_leave_rows_clean(people):
    report = validate(people, [R("age", "is_greater_than", 20, threshold=0.5)])
    assert report.get_bad_df().count() == 0 and report.split("all_rules")[1].count() == 1
    assert validate(people, []).split()[0].count() == 4


def test_summary(people):
    report = validate(people, [R("country", "is_in", ["US"]), R("id", "is_complete")])
    s = report.summary(key_columns=["id"])
    assert (s["passed"], s["failed"], s["total_rows"]) == (1, 1, 4)
    assert s["validations"][0]["fail_count"] == 2 and sorted(s["validations"][0]["sample_violating_ids"]) == [2, 4]
    assert report.to_df().count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.sampled_from(["a", "b", ""]))), max_size=12), st.sampled_from(["skip", "fail"]))
def test_split_property(spark, rows, policy):
    df = spark.createDataFrame(rows, "n int, s string")
    report = validate(df, [R("n", "is_unique"), R("n", "is_less_than", 3), R("s", "is_legit"), R("s", "is_in", ["a"])], null_policy=policy)
    good, bad = report.split()
    both = good.unionByName(bad.drop("_dq_errors"))
    assert both.exceptAll(df).count() == 0 and df.exceptAll(both).count() == 0
    seen = [n for n, _ in rows]
    assert report[0].fail_count == sum(seen.count(n) > 1 for n in seen)
    assert report[2].fail_count == sum(s is None or not s.strip() for _, s in rows)
