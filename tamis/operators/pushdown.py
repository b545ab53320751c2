"""Validation where the data is: one SELECT runs in the warehouse, one row comes back and is judged here."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import SparkSession

from ..plans.planner import told
from ..plans.sqlgen import DIALECTS, compile_rules_to_sql, results_from_row
from ..report import ValidationReport, ValidationStatus
from ..rules import RuleDefinition

#: Takes SQL of the engine's dialect, gives its one row by column.
Runner = Callable[[str], Mapping[str, Any]]


def jdbc_runner(spark: SparkSession, url: str, properties: Mapping[str, str] | None = None) -> Runner:
    """Runs a SELECT over JDBC. Only its row is read: the engine does the scan."""

    def run(sql: str) -> Mapping[str, Any]:
        row = spark.read.format("jdbc").options(**(properties or {})).option("url", url).option("query", sql).load().first()
        return {k.lower(): v for k, v in row.asDict().items()}

    return run


def connection_runner(connection: Any) -> Runner:
    """Runs a SELECT on an open java.sql.Connection of the driver's JVM: for an engine embedded there, which no executor can reach."""

    def plain(x: Any) -> Any:
        kind = x.getClass().getName() if hasattr(x, "getClass") else ""
        return {"java.sql.Date": date.fromisoformat, "java.sql.Timestamp": datetime.fromisoformat}.get(kind, str)(x.toString()) if kind else x

    def run(sql: str) -> Mapping[str, Any]:
        statement = connection.createStatement()
        try:
            rows = statement.executeQuery(sql)
            rows.next()
            names = rows.getMetaData()
            return {names.getColumnLabel(i).lower(): plain(rows.getObject(i)) for i in range(1, names.getColumnCount() + 1)}
        finally:
            statement.close()

    return run


def polled_runner(submit: Callable[[str], Any], state: Callable[[Any], str], fetch: Callable[[Any], Mapping[str, Any]], cancel: Callable[[Any], None] | None = None, limit: float = 600.0, interval: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Runner:
    """Runs a SELECT on an engine that only takes jobs: submit gives an id, whose state is asked until it is an end.

    States are words, in any case: SUCCEEDED or DONE; FAILED, CANCELLED or ERROR; all others are waited for, ever longer up to 16
    intervals. After limit seconds the job is cancelled, and TimeoutError raised.
    """

    def run(sql: str) -> Mapping[str, Any]:
        job, began, wait = submit(sql), clock(), interval
        while True:
            now = str(state(job)).upper()
            if now in ("SUCCEEDED", "DONE"):
                return {k.lower(): v for k, v in fetch(job).items()}
            if now in ("FAILED", "CANCELLED", "ERROR"):
                raise RuntimeError(f"job {job} ended as {now}")
            if clock() - began >= limit:
                if cancel:
                    cancel(job)
                raise TimeoutError(f"job {job} was not done after {limit} s")
            sleep(min(wait, max(0.0, limit - (clock() - began))))
            wait = min(2 * wait, 16 * interval)

    return run


def validate_pushed(run: Runner, table: str, rules: Sequence[RuleDefinition], dialect: str, where: str | None = None, as_of: date | str | None = None, null_policy: str = "skip") -> ValidationReport:
    """Judge rules by the rows that SELECTs in the engine's dialect give; all rules are one SELECT, unless one of them fails.

    A rule that the dialect can't express is an ERROR by itself. If the SELECT fails, its rules are tried in halves, so that only the
    faulty ones are errors. If not even the rows can be counted, the exception is the caller's.
    """
    began = time.time()
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect '{dialect}'")
    errors: dict[int, str] = {}
    for i, r in enumerate(rules):
        try:
            if r.execute:
                compile_rules_to_sql([r], table, dialect, where, as_of, null_policy, counts=True)
        except ValueError as e:
            errors[i] = told(e)
    row: dict[str, Any] = {}
    todo = [[i for i, r in enumerate(rules) if r.execute and i not in errors]]
    while todo:
        own = todo.pop()
        sql = _select(table, rules, own, dialect, where, as_of, null_policy)
        try:
            row |= run(sql)
        except TimeoutError:
            raise
        except Exception as e:  # whatever the engine or its driver raises
            if not own:
                raise
            if len(own) == 1:
                errors[own[0]] = told(e)
            else:
                todo += [own[: len(own) // 2], own[len(own) // 2 :]]
    if "total_rows" not in row:  # is it the rules or the table?
        row |= run(_select(table, rules, [], dialect, where, as_of, null_policy))
    report = results_from_row(row, rules, int(row["total_rows"]))
    for i, message in errors.items():
        report[i].status, report[i].message = ValidationStatus.ERROR, message
    report.execution_time_ms, report.engine = round(1000 * (time.time() - began), 2), dialect
    report.generated_sql = _select(table, rules, [i for i in range(len(rules)) if rules[i].execute and i not in errors], dialect, where, as_of, null_policy)
    return report


def _select(table: str, rules: Sequence[RuleDefinition], own: Sequence[int], dialect: str, where: str | None, as_of: date | str | None, null_policy: str) -> str:
    """The SELECT of some of the rules, under their own numbers, and of the number of rows."""
    chosen = set(own)
    return compile_rules_to_sql(rules, table, dialect, where, as_of, null_policy, counts=True, total="total_rows", only=chosen)[0]
