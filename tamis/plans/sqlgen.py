"""Rules as one SELECT, for Spark or another engine: the same metrics without running anything here."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Mapping, Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import SparkSession

from ..functions.predicates import DAYS, FIRST_DATE, NULL_FAILS, RuleError, java_pattern
from ..report import ValidationLevel, ValidationReport, ValidationResult, ValidationStatus
from ..rules import RuleDefinition

DIALECTS = ("spark", "databricks", "duckdb", "postgres", "snowflake", "bigquery", "trino", "redshift", "doris", "athena", "derby")
_BACKTICK = ("spark", "databricks", "bigquery", "doris")


def literal(value: Any, dialect: str = "") -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP('{value.isoformat(sep=' ')}')" if dialect == "derby" else f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE('{value.isoformat()}')" if dialect == "derby" else f"DATE '{value.isoformat()}'"
    if value is None:
        raise RuleError("the check needs a value")
    return "'" + str(value).replace("'", "''") + "'"


def identifier(name: str, dialect: str, whole: bool = False) -> str:
    """A quoted name; its parts between dots by themselves, unless it is one whole."""
    q = "`" if dialect in _BACKTICK else '"'
    return ".".join(f"{q}{p.replace(q, q + q)}{q}" for p in ([name] if whole else name.split(".")))


def try_cast(c: str, kind: str, dialect: str) -> str:
    """c as a value of that type, NULL where it can't be one; as far as the dialect can try."""
    if dialect == "postgres":  # from version 16; a plain cast would stop at text that has no such value
        return f"CASE WHEN pg_input_is_valid(CAST({c} AS TEXT), {literal(kind.lower())}) THEN CAST(CAST({c} AS TEXT) AS {kind}) END"
    cast = {"doris": "CAST", "derby": "CAST", "bigquery": "SAFE_CAST"}.get(dialect, "TRY_CAST")  # a cast gives NULL in Doris
    return f"{cast}({c} AS {kind})"


def days_before(day: str, n: int, dialect: str) -> str:
    """The day n days before a day."""
    if dialect == "derby":
        return f"CAST({{fn TIMESTAMPADD(SQL_TSI_DAY, -{n}, CAST({day} AS TIMESTAMP))}} AS DATE)"
    if dialect in ("spark", "databricks"):
        return f"DATE_SUB({day}, {n})"
    if dialect in ("bigquery", "doris"):
        return f"DATE_SUB({day}, INTERVAL {n} DAY)"
    if dialect in ("snowflake", "redshift"):
        return f"DATEADD(day, -{n}, {day})"
    return f"CAST({day} - INTERVAL '{n}' DAY AS DATE)"


def weekday(d: str, dialect: str) -> str:
    """1 for Sunday to 7 for Saturday."""
    if dialect == "derby":  # days since a Sunday
        return f"(MOD({{fn TIMESTAMPDIFF(SQL_TSI_DAY, TIMESTAMP('1899-12-31 00:00:00'), CAST({d} AS TIMESTAMP))}}, 7) + 1)"
    form = {
        "spark": "DAYOFWEEK({})", "databricks": "DAYOFWEEK({})", "doris": "DAYOFWEEK({})", "bigquery": "EXTRACT(DAYOFWEEK FROM {})", "duckdb": "(DAYOFWEEK({}) + 1)",
        "snowflake": "(MOD(DAYOFWEEKISO({}), 7) + 1)", "postgres": "(EXTRACT(DOW FROM {}) + 1)", "redshift": "(EXTRACT(DOW FROM {}) + 1)", "trino": "(DAY_OF_WEEK({}) % 7 + 1)", "athena": "(DAY_OF_WEEK({}) % 7 + 1)",
    }
    return form[dialect].format(d)


def matches(c: str, pattern: str, dialect: str) -> str:
    """Whether the pattern is found anywhere in c."""
    if dialect == "derby":
        raise RuleError("the dialect derby has no patterns")
    p = literal(pattern, dialect)
    if dialect in ("spark", "databricks"):
        return f"{c} RLIKE r{p}" if "''" not in p else f"{c} RLIKE {p.replace(chr(92), chr(92) * 2)}"
    form = {"duckdb": "REGEXP_MATCHES({}, {})", "bigquery": "REGEXP_CONTAINS({}, r{})", "snowflake": "REGEXP_INSTR({}, {}) > 0", "postgres": "{} ~ {}", "redshift": "{} ~ {}", "doris": "{} REGEXP {}"}
    return form.get(dialect, "REGEXP_LIKE({}, {})").format(c, p)


def parsed_time(c: str, form: str, dialect: str) -> str:
    """c read in a strftime format, NULL where it isn't in it."""
    if dialect in ("spark", "databricks"):
        return f"TRY_TO_TIMESTAMP({c}, {literal(java_pattern(form))})"
    if "%" not in form:
        raise RuleError(f"the format {form!r} is not in strftime's letters, and the dialect {dialect} has no other")
    if dialect == "duckdb":
        return f"TRY_STRPTIME({c}, {literal(form)})"
    if dialect == "bigquery":
        return f"SAFE.PARSE_TIMESTAMP({literal(form)}, {c})"
    if dialect in ("trino", "athena"):
        return f"TRY(DATE_PARSE({c}, {literal(_letters(form, MYSQL, '%'))}))"
    if dialect == "doris":
        return f"STR_TO_DATE({c}, {literal(_letters(form, MYSQL, '%'))})"
    if dialect == "snowflake":
        return f"TRY_TO_TIMESTAMP({c}, {literal(_letters(form, SNOWFLAKE, ''))})"
    raise RuleError(f"the dialect {dialect} can't try a format without failing")


class _Writer:
    """Conditions that hold where a row fails."""

    def __init__(self, dialect: str, as_of: date | None) -> None:
        self.dialect = dialect
        self.now = literal(as_of, dialect) if as_of else "CURRENT_DATE"

    def col(self, rule: RuleDefinition) -> str:
        return identifier(rule.fields[0], self.dialect)

    def day(self, rule: RuleDefinition) -> str:
        return try_cast(self.col(rule), "DATE", self.dialect)

    def ago(self, n: int) -> str:
        return days_before(self.now, n, self.dialect)

    def weekday(self, rule: RuleDefinition) -> str:
        return weekday(self.day(rule), self.dialect)

    def matches(self, rule: RuleDefinition, pattern: str) -> str:
        return matches(self.col(rule), pattern, self.dialect)

    def list_of(self, rule: RuleDefinition) -> str:
        if not isinstance(rule.value, (list, tuple)) or not rule.value:
            raise RuleError("the check needs a list of values")
        return ", ".join(literal(v, self.dialect) for v in rule.value)

    def bounds(self, rule: RuleDefinition) -> tuple[str, str]:
        if not isinstance(rule.value, (list, tuple)) or len(rule.value) != 2:
            raise RuleError("the check needs a list of two values")
        return literal(rule.value[0], self.dialect), literal(rule.value[1], self.dialect)

    def date_bounds(self, rule: RuleDefinition) -> tuple[str, str]:
        low, high = self.bounds(rule)
        return tuple(x if x.startswith("DATE") else f"DATE({x})" if self.dialect == "derby" else f"DATE {x}" for x in (low, high))

    def format_fails(self, rule: RuleDefinition) -> str:
        c, form = self.col(rule), str(rule.value or "")
        return f"{c} IS NOT NULL AND {parsed_time(c, form, self.dialect) if form else self.day(rule)} IS NULL"


# Letters of strftime, and those of the same meaning after % in MySQL's formats, and in Snowflake's.
MYSQL = {"Y": "Y", "y": "y", "m": "m", "d": "d", "H": "H", "I": "h", "M": "i", "S": "s", "f": "f", "b": "b", "B": "M", "a": "a", "A": "W", "p": "p", "j": "j", "%": "%"}
SNOWFLAKE = {"Y": "YYYY", "y": "YY", "m": "MM", "d": "DD", "H": "HH24", "I": "HH12", "M": "MI", "S": "SS", "f": "FF6", "b": "MON", "B": "MMMM", "a": "DY", "p": "AM"}


def _letters(form: str, known: Mapping[str, str], mark: str) -> str:
    """A strftime format in another system's letters."""

    def letter(m: re.Match) -> str:
        if m[1] not in known:
            raise RuleError(f"format letter %{m[1]} is not supported")
        return mark + known[m[1]]

    return re.sub("%(.)", letter, form)


_FAILS: dict[str, Callable[[_Writer, RuleDefinition], str]] = {
    "is_complete": lambda w, r: f"{w.col(r)} IS NULL",
    "are_complete": lambda w, r: " OR ".join(f"{identifier(f, w.dialect)} IS NULL" for f in r.fields),
    "is_equal": lambda w, r: f"{w.col(r)} <> {literal(r.value, w.dialect)}",
    "is_equal_than": lambda w, r: f"{w.col(r)} <> {identifier(str(r.value), w.dialect)}",
    "is_between": lambda w, r: "NOT ({} BETWEEN {} AND {})".format(w.col(r), *w.bounds(r)),
    "is_greater_than": lambda w, r: f"{w.col(r)} <= {literal(r.value, w.dialect)}",
    "is_less_than": lambda w, r: f"{w.col(r)} >= {literal(r.value, w.dialect)}",
    "is_greater_or_equal_than": lambda w, r: f"{w.col(r)} < {literal(r.value, w.dialect)}",
    "is_less_or_equal_than": lambda w, r: f"{w.col(r)} > {literal(r.value, w.dialect)}",
    "is_positive": lambda w, r: f"{w.col(r)} <= 0",
    "is_negative": lambda w, r: f"{w.col(r)} >= 0",
    "is_in_millions": lambda w, r: f"{w.col(r)} < 1000000",
    "is_in_billions": lambda w, r: f"{w.col(r)} < 1000000000",
    "is_contained_in": lambda w, r: f"{w.col(r)} NOT IN ({w.list_of(r)})",
    "not_contained_in": lambda w, r: f"{w.col(r)} IN ({w.list_of(r)})",
    "has_pattern": lambda w, r: f"NOT ({w.matches(r, str(r.value))})",
    "is_legit": lambda w, r: f"{w.col(r)} IS NULL OR NOT ({w.matches(r, '[^[:space:]]' if w.dialect in ('postgres', 'redshift') else chr(92) + 'S')})",
    "is_today": lambda w, r: f"{w.day(r)} <> {w.now}",
    "is_t_minus_1": lambda w, r: f"{w.day(r)} <> {w.ago(1)}",
    "is_t_minus_2": lambda w, r: f"{w.day(r)} <> {w.ago(2)}",
    "is_t_minus_3": lambda w, r: f"{w.day(r)} <> {w.ago(3)}",
    "is_past_date": lambda w, r: f"{w.day(r)} >= {w.now}",
    "is_future_date": lambda w, r: f"{w.day(r)} <= {w.now}",
    "is_date_between": lambda w, r: "NOT ({} BETWEEN {} AND {})".format(w.day(r), *w.date_bounds(r)),
    "is_date_after": lambda w, r: f"{w.day(r)} <= {literal(r.value, w.dialect)}",
    "is_date_before": lambda w, r: f"{w.day(r)} >= {literal(r.value, w.dialect)}",
    "is_on_weekday": lambda w, r: f"{w.weekday(r)} IN (1, 7)",
    "is_on_weekend": lambda w, r: f"{w.weekday(r)} NOT IN (1, 7)",
    "validate_date_format": _Writer.format_fails,
    "all_date_checks": lambda w, r: f"{w.col(r)} IS NOT NULL AND ({w.day(r)} IS NULL OR {w.day(r)} > {w.now} OR {w.day(r)} < {literal(FIRST_DATE, w.dialect)})",
    "satisfies": lambda w, r: f"NOT ({r.value})",
} | {f"is_on_{name}": (lambda w, r, i=i: f"{w.weekday(r)} <> {i}") for i, name in enumerate(DAYS, 1)}

_AGGREGATES = {"has_min": "MIN({})", "has_max": "MAX({})", "has_sum": "SUM({})", "has_mean": "AVG({})", "has_std": "STDDEV_SAMP({})", "has_cardinality": "COUNT(DISTINCT {})"}


def fail_condition(rule: RuleDefinition, dialect: str = "spark", as_of: date | str | None = None) -> str:
    """SQL that is true where a row fails, and NULL where it can't be judged."""
    if rule.canonical not in _FAILS:
        raise RuleError(f"'{rule.check_type}' has no condition on rows")
    return _FAILS[rule.canonical](_Writer(dialect, date.fromisoformat(as_of) if isinstance(as_of, str) else as_of), rule)


def distinct_key(names: Sequence[str], dialect: str) -> str:
    if len(names) == 1:
        return names[0]
    if dialect in ("duckdb", "postgres", "trino", "athena"):
        return f"({', '.join(names)})"
    if dialect == "bigquery":
        return f"TO_JSON_STRING(STRUCT({', '.join(names)}))"
    if dialect in ("redshift", "derby"):
        raise RuleError(f"{dialect} counts no distinct keys of several columns")
    return ", ".join(names)


def _measure(rule: RuleDefinition, dialect: str, as_of: date | str | None, null_policy: str) -> dict[str, str]:
    """The expressions of a rule: "rule", its rate or aggregate; for row rules "rows" and "fails", exact numbers. A filter is a CASE, which
    every dialect has."""
    name = rule.canonical
    names = [identifier(f, dialect) for f in rule.fields]

    def where(value: str) -> str:
        return f"CASE WHEN {rule.filter} THEN {value} END" if rule.filter else value

    rows = f"COUNT({where('1')})"
    if name in ("is_unique", "are_unique"):
        # The share of distinct keys; the duplicate-group count needs a grouping, which one SELECT hasn't.
        keys = [where(n) for n in names]
        return {"rule": f"COALESCE(COUNT(DISTINCT {distinct_key(keys, dialect)}) * 1.0 / NULLIF({rows}, 0), 1.0)"}
    if name in _AGGREGATES:
        value = where(names[0])
        if dialect == "derby" and name in ("has_mean", "has_std"):  # whole numbers have whole means there
            value = f"CAST({value} AS DOUBLE)"
        return {"rule": _AGGREGATES[name].format(value)}
    if name not in _FAILS:
        raise RuleError(f"'{rule.check_type}' is no expression of one SELECT")
    failed = fail_condition(rule, dialect, as_of)
    unknown = "1.0" if null_policy == "skip" or name in NULL_FAILS else "0.0"
    fails = f"CASE WHEN {failed} THEN 1 WHEN NOT ({failed}) THEN 0 ELSE {1 if unknown == '0.0' else 0} END"
    passes = f"CASE WHEN {failed} THEN 0.0 WHEN NOT ({failed}) THEN 1.0 ELSE {unknown} END"
    return {"rule": f"COALESCE(AVG({where(passes)}), 1.0)", "rows": rows, "fails": f"COALESCE(SUM({where(fails)}), 0)"}


def compile_rules_to_sql(rules: Sequence[RuleDefinition], table: str, dialect: str = "spark", where: str | None = None, as_of: date | str | None = None, null_policy: str = "skip", counts: bool = False, total: str | None = None, only: Collection[int] | None = None) -> tuple[str, list[str]]:
    """One SELECT with a column rule_<i> for each rule, and the rules' ids; ("", []) without rules.

    total: the name of a column with the number of rows, which is there even without rules. only: numbers of the rules to take.

    Row rules give their pass rate (1 for no rows), table rules their aggregate. With counts, row rules also have rows_<i>, the rows
    looked at, and fails_<i>, which results_from_row then gives instead of reckoning. A rule that SQL of one SELECT can't express raises RuleError.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect '{dialect}'")
    active = [(i, r) for i, r in enumerate(rules) if r.execute and (only is None or i in only)]
    if not active and not total:
        return "", []
    measured = [(i, k, v) for i, r in active for k, v in _measure(r, dialect, as_of, null_policy).items() if counts or k == "rule"]
    columns = ",\n  ".join([*([f"COUNT(*) AS {total}"] if total else []), *(f"{v} AS {k}_{i}" for i, k, v in measured)])
    condition = f"\nWHERE {where}" if where else ""
    return f"SELECT\n  {columns}\nFROM {identifier(table, dialect)}{condition}", [f"{i}:{r.key}" for i, r in active]


def get_validation_sql(rules: Sequence[RuleDefinition], table: str, dialect: str = "spark", where: str | None = None) -> str:
    return compile_rules_to_sql(rules, table, dialect, where)[0]


def results_from_row(row: Mapping[str, Any], rules: Sequence[RuleDefinition], total_rows: int) -> ValidationReport:
    """Verdicts from the row that a compiled SELECT gave. Without its counts, failures are reckoned from the rate; of a rule with a filter
    they aren't known then."""
    results = []
    for i, rule in enumerate(rules):
        out = ValidationResult(f"{i}:{rule.key}", ValidationLevel(rule.level), rule.category, rule.check_type, rule.label, ValidationStatus.ERROR, expected=rule.value, total_rows=total_rows)
        results.append(out)
        if f"rule_{i}" not in row:
            out.message = "Skipped: execute=False" if not rule.execute else "Error: not in the result"
            continue
        value = row[f"rule_{i}"]
        if rule.level == "ROW":
            out.pass_rate = out.actual = 1.0 if value is None else float(value)
            out.expected = 1.0 if rule.threshold is None else rule.threshold
            if f"fails_{i}" in row:
                out.total_rows, out.fail_count = int(row[f"rows_{i}"]), int(row[f"fails_{i}"])
                out.pass_rate = out.actual = (out.total_rows - out.fail_count) / out.total_rows if out.total_rows else 1.0
            else:
                out.fail_count = None if rule.filter else round(total_rows * (1 - out.pass_rate))
            good = out.pass_rate >= out.expected
        elif rule.value is None:
            out.message = "Error: the check needs an expected value"
            continue
        else:
            out.actual = value
            good = value is not None and abs(float(value) - float(rule.value)) <= (rule.threshold or 0.0) * abs(float(rule.value))
            out.pass_rate = float(good)
        out.status = ValidationStatus.PASS if good else ValidationStatus.FAIL
    return ValidationReport(results, total_rows, 0.0, engine="sql")


def transpile(sql: str, source: str, target: str, spark: SparkSession | None = None) -> str:
    """SQL of one dialect as that of another.

    A SELECT of Spark is read by Spark's own parser and printed for the target. What that can't do, and other sources, need the optional
    sqlglot package.
    """
    from .transpile import from_spark

    reason = f"transpile from {source} needs the sqlglot package"
    session = spark or SparkSession.getActiveSession()
    if source in ("spark", "databricks") and session is not None:
        try:
            return from_spark(session, sql, target)
        except (NotImplementedError, RuleError) as e:
            reason = str(e)
    try:
        import sqlglot
    except ImportError as e:
        raise NotImplementedError(reason) from e
    return sqlglot.transpile(sql, read=source, write=target, pretty=True)[0]
