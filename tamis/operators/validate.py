"""validate(): measure all rules, give a verdict on each."""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import date
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..functions.predicates import TABLE_RULES
from ..plans.planner import BoundRule, ValidationPlan, bind, told
from ..report import ValidationLevel, ValidationReport, ValidationResult, ValidationStatus
from ..rules import RuleDefinition
from .schema_contract import SchemaDef, validate_schema

#: What is counted, by category, for the message of a failure.
_FAULTS = {"is_complete": "null value(s) found", "are_complete": "row(s) incomplete", "is_unique": "duplicate value(s) found", "are_unique": "duplicate value(s) found"}


def validate(df: DataFrame | str, rules: Sequence[RuleDefinition], as_of: date | str | None = None, null_policy: str = "skip", where: str | None = None, approx: bool = False, spark: SparkSession | None = None) -> ValidationReport:
    """Measure the rules on df (or the table or view of that name) and compare with their thresholds.

    as_of: the day that counts as today. null_policy: "skip" passes values that can't be judged, "fail" doesn't. where: SQL that
    limits the rows. approx: distinct counts by sketch. One action runs, with one scan and one more for each set of key columns.
    """
    began = time.time()
    if isinstance(df, str):
        df = (spark or SparkSession.active()).table(df)
    plan = bind(df, rules, as_of, null_policy, where, approx)
    report = report_of(plan, measure(plan))
    report.execution_time_ms = round(1000 * (time.time() - began), 2)
    return report


def report_of(plan: ValidationPlan, found: dict[int, Any]) -> ValidationReport:
    """Verdicts from the rows of METRIC_SCHEMA, by rule number."""
    total = found[-1]["total"]
    return ValidationReport([_verdict(plan, i, b, found, total) for i, b in enumerate(plan.bound)], total, 0.0, plan)


def measure(plan: ValidationPlan) -> dict[int, Any]:
    """The plan's metrics by rule number. If a rule fails on the data, its error is put on it, and the others are measured without it.

    Rules are tried again in halves, so each faulty one costs a number of passes that grows with the logarithm of the rules.
    """
    try:
        return {r["i"]: r for r in plan.metrics_frame.collect()}
    except (PySparkException, Py4JJavaError) as e:
        failure = e
    found = {r["i"]: r for r in plan.only(()).metrics().collect()}  # raises if the fault is the table's
    todo = [[i for i, b in enumerate(plan.bound) if not b.error and b.kind not in ("schema", "none")]]
    if len(todo[0]) == 1:
        plan.bound[todo.pop()[0]].error = told(failure)
    else:
        todo = [todo[0][: len(todo[0]) // 2], todo[0][len(todo[0]) // 2 :]]
    while todo:
        own = todo.pop()
        try:
            found |= {r["i"]: r for r in plan.only(own).metrics().collect()}
        except (PySparkException, Py4JJavaError) as e:
            if len(own) == 1:
                plan.bound[own[0]].error = told(e)
            else:
                todo += [own[: len(own) // 2], own[len(own) // 2 :]]
    return found


def _verdict(plan: ValidationPlan, i: int, b: BoundRule, found: dict[int, Any], all_rows: int) -> ValidationResult:
    rule = b.rule
    out = ValidationResult(b.rule_id, ValidationLevel(rule.level), rule.category, rule.check_type, rule.label, ValidationStatus.ERROR, expected=rule.value, total_rows=all_rows, message=b.error, metadata=dict(rule.metadata))
    if b.error:
        return out
    if b.kind == "schema":
        return _schema_verdict(plan, rule, out)
    row = found.get(i)
    if row is None:
        out.message = "Error: nothing was measured"
        return out
    rows = found[-2 - i]["total"] if -2 - i in found else row["total"] if row["total"] is not None else all_rows
    out.total_rows = rows
    threshold = rule.threshold
    if rule.level == "ROW":
        out.fail_count = row["fails"]
        out.pass_rate = (rows - row["fails"]) / rows if rows else 1.0
        out.expected, out.actual = 1.0 if threshold is None else threshold, out.pass_rate
        out.status = ValidationStatus.PASS if out.pass_rate >= out.expected else ValidationStatus.FAIL
        out.message = None if out.status is ValidationStatus.PASS else f"{out.fail_count} {_FAULTS.get(rule.canonical, 'row(s) failed validation')}"
        return out
    out.actual = row["number"] if row["number"] is not None else row["text"]
    own = TABLE_RULES[rule.canonical].meets if rule.canonical in TABLE_RULES else None
    if rule.value is None and own is None:
        out.message = "Error: the check needs an expected value"
        return out
    try:
        good = bool(own(out.actual, rule)) if own else _meets(row, rule.value, threshold or 0.0)
    except Exception as e:  # a user's own verdict may raise anything
        out.message = told(e)
        return out
    out.pass_rate = float(good)
    out.status = ValidationStatus.PASS if good else ValidationStatus.FAIL
    out.message = None if good else f"Expected {rule.value}, got {out.actual}"
    return out


def _meets(row: Any, expected: Any, tolerance: float) -> bool:
    """|actual - expected| <= tolerance * |expected|; dates and text have to be equal; nothing measured meets nothing."""
    if row["text"] is None:
        return False
    if isinstance(expected, (int, float)) and row["number"] is not None:
        return abs(row["number"] - expected) <= tolerance * abs(expected)
    if isinstance(expected, date):
        return row["text"][:10] == expected.isoformat()[:10]
    return row["text"] == str(expected)


def _schema_verdict(plan: ValidationPlan, rule: RuleDefinition, out: ValidationResult) -> ValidationResult:
    if not isinstance(rule.value, (dict, SchemaDef)):
        out.message = "Error: the check needs a schema contract"
        return out
    try:
        contract = rule.value if isinstance(rule.value, SchemaDef) else SchemaDef.from_dict(rule.value)
        checked = validate_schema(plan.df, contract)
    except Exception as e:  # a contract that can't be read is this rule's fault alone
        out.message = told(e)
        return out
    out.actual, out.expected = checked.total_issues, 0
    out.pass_rate, out.fail_count = float(checked.passed), checked.total_issues
    out.status = ValidationStatus.PASS if checked.passed else ValidationStatus.FAIL
    out.message = None if checked.passed else "; ".join(checked.issues())
    return out
