"""Fail predicates of the row checks, as columns; NULL means that the row can't be judged. No Python runs on rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import MANIFEST, Check, RuleDefinition

#: Checks for which NULL is a failure, whatever the null policy.
NULL_FAILS = {"is_complete", "are_complete", "is_legit"}
FIRST_DATE = date(1900, 1, 1)


class RuleError(ValueError):
    """A rule that can't be applied to this table; the message is for its user."""


@dataclass(frozen=True)
class Context:
    """What a predicate may depend on besides its rule: the table's schema and the day that counts as today."""

    schema: T.StructType
    as_of: Column

    def kind(self, name: str) -> T.DataType:
        return self.schema[name].dataType


_NUMERIC = (T.NumericType,)


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _number(ctx: Context, name: str) -> Column:
    """The field as a number: text is tried, and NULL where it isn't one."""
    return _col(name) if isinstance(ctx.kind(name), _NUMERIC) else _col(name).try_cast("double")


def _day(ctx: Context, name: str) -> Column:
    """The field as a date; text that isn't one is NULL."""
    kind = ctx.kind(name)
    if isinstance(kind, T.DateType):
        return _col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _col(name).cast("date")
    if isinstance(kind, T.StringType):
        return _col(name).try_cast("date")
    raise RuleError(f"field '{name}' is no date")


def _as_date(value: Any) -> Column:
    if isinstance(value, datetime):
        value = value.date()
    if isinstance(value, str):
        try:
            value = date.fromisoformat(value.strip()[:10])
        except ValueError as e:
            raise RuleError(f"{value!r} is no date") from e
    if not isinstance(value, date):
        raise RuleError(f"{value!r} is no date")
    return F.lit(value)


def _comparable(ctx: Context, name: str, value: Any) -> tuple[Column, Column]:
    """Field and value as columns of one kind."""
    kind = ctx.kind(name)
    if value is None:
        raise RuleError("the check needs a value")
    if isinstance(value, datetime):
        return (_col(name).try_cast("timestamp") if isinstance(kind, T.StringType) else _col(name)), F.lit(value)
    if isinstance(value, date):
        return _day(ctx, name), F.lit(value)
    if isinstance(value, bool):
        return (_col(name).try_cast("boolean") if isinstance(kind, T.StringType) else _col(name)), F.lit(value)
    if isinstance(value, (int, float)):
        return _number(ctx, name), F.lit(value)
    if isinstance(kind, _NUMERIC):
        try:
            return _col(name), F.lit(float(value))
        except (TypeError, ValueError) as e:
            raise RuleError(f"{value!r} is no number") from e
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _day(ctx, name), _as_date(value)
    return _col(name), F.lit(value)


def _pair(rule: RuleDefinition) -> tuple[Any, Any]:
    if not isinstance(rule.value, (list, tuple)) or len(rule.value) != 2:
        raise RuleError("the check needs a list of two values")
    return rule.value[0], rule.value[1]


def _one(rule: RuleDefinition) -> str:
    if len(rule.fields) != 1:
        raise RuleError("the check needs one field")
    return rule.fields[0]


_BUILD: dict[str, Callable[[Context, RuleDefinition], Column]] = {}


def builds(*names: str) -> Callable:
    def keep(f: Callable[[Context, RuleDefinition], Column]) -> Callable:
        for n in names:
            _BUILD[n] = f
        return f

    return keep


@builds("is_complete")
def _complete(ctx: Context, rule: RuleDefinition) -> Column:
    return _col(_one(rule)).isNull()


@builds("are_complete")
def _all_complete(ctx: Context, rule: RuleDefinition) -> Column:
    return reduce(Column.__or__, (_col(f).isNull() for f in rule.fields))


def _against(fails: Callable[[Column, Column], Column]) -> Callable[[Context, RuleDefinition], Column]:
    return lambda ctx, rule: fails(*_comparable(ctx, _one(rule), rule.value))


_BUILD |= {
    "is_equal": _against(lambda c, v: c != v),
    "is_greater_than": _against(lambda c, v: c <= v),
    "is_less_than": _against(lambda c, v: c >= v),
    "is_greater_or_equal_than": _against(lambda c, v: c < v),
    "is_less_or_equal_than": _against(lambda c, v: c > v),
    "is_positive": lambda ctx, rule: _number(ctx, _one(rule)) <= 0,
    "is_negative": lambda ctx, rule: _number(ctx, _one(rule)) >= 0,
    "is_in_millions": lambda ctx, rule: _number(ctx, _one(rule)) < 10**6,
    "is_in_billions": lambda ctx, rule: _number(ctx, _one(rule)) < 10**9,
}


@builds("is_equal_than")
def _other_column(ctx: Context, rule: RuleDefinition) -> Column:
    name, other = _one(rule), rule.value
    if not isinstance(other, str) or other not in ctx.schema.fieldNames():
        raise RuleError(f"there is no field '{other}' to compare with")
    a, b = ctx.kind(name), ctx.kind(other)
    if isinstance(a, _NUMERIC) != isinstance(b, _NUMERIC):
        return _number(ctx, name) != _number(ctx, other)
    return _col(name) != _col(other)


@builds("is_between")
def _between(ctx: Context, rule: RuleDefinition) -> Column:
    low, high = _pair(rule)
    (c, lo), (_, hi) = _comparable(ctx, _one(rule), low), _comparable(ctx, _one(rule), high)
    return ~c.between(lo, hi)


def _member(ctx: Context, rule: RuleDefinition) -> Column:
    if not isinstance(rule.value, (list, tuple)):
        raise RuleError("the check needs a list of values")
    name, values = _one(rule), list(rule.value)
    kind = ctx.kind(name)
    if isinstance(kind, T.StringType):
        values = [str(v) for v in values]
        return _col(name).isin(values)
    columns = [_comparable(ctx, name, v)[1] for v in values]
    return _comparable(ctx, name, values[0])[0].isin(*columns) if columns else F.lit(False)


_BUILD["is_contained_in"] = lambda ctx, rule: ~_member(ctx, rule)
_BUILD["not_contained_in"] = _member


@builds("has_pattern")
def _pattern(ctx: Context, rule: RuleDefinition) -> Column:
    if not rule.value:
        raise RuleError("the check needs a pattern")
    return ~_col(_one(rule)).cast("string").rlike(str(rule.value))


@builds("is_legit")
def _legit(ctx: Context, rule: RuleDefinition) -> Column:
    c = _col(_one(rule))
    return c.isNull() | ~c.cast("string").rlike(r"\S")


def _dated(fails: Callable[[Column, Column], Column]) -> Callable[[Context, RuleDefinition], Column]:
    return lambda ctx, rule: fails(_day(ctx, _one(rule)), ctx.as_of)


_BUILD |= {
    "is_today": _dated(lambda d, now: d != now),
    "is_t_minus_1": _dated(lambda d, now: d != F.date_sub(now, 1)),
    "is_t_minus_2": _dated(lambda d, now: d != F.date_sub(now, 2)),
    "is_t_minus_3": _dated(lambda d, now: d != F.date_sub(now, 3)),
    "is_past_date": _dated(lambda d, now: d >= now),
    "is_future_date": _dated(lambda d, now: d <= now),
    "is_on_weekday": _dated(lambda d, _: F.dayofweek(d).isin(1, 7)),
    "is_on_weekend": _dated(lambda d, _: ~F.dayofweek(d).isin(1, 7)),
    "is_date_after": lambda ctx, rule: _day(ctx, _one(rule)) <= _as_date(rule.value),
    "is_date_before": lambda ctx, rule: _day(ctx, _one(rule)) >= _as_date(rule.value),
}
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
for _i, _name in enumerate(DAYS, 1):
    _BUILD[f"is_on_{_name}"] = _dated(lambda d, _, i=_i: F.dayofweek(d) != i)


@builds("is_date_between")
def _date_between(ctx: Context, rule: RuleDefinition) -> Column:
    low, high = _pair(rule)
    return ~_day(ctx, _one(rule)).between(_as_date(low), _as_date(high))


# strftime's letters and the patterns that Spark has for them.
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "j": "DDD", "z": "xx", "%": "%"}


def java_pattern(form: str) -> str:
    """A strftime format as a Spark date-time pattern; one without % is taken as it is."""
    if "%" not in form:
        return form
    out, text, i = [], "", 0

    def literal() -> None:
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'" if any(ch.isalpha() or ch == "'" for ch in text) else text)
        text = ""

    while i < len(form):
        if form[i] == "%" and i + 1 < len(form):
            if form[i + 1] not in STRFTIME:
                raise RuleError(f"format letter %{form[i + 1]} is not supported")
            if form[i + 1] == "%":
                text += "%"
            else:
                literal()
                out.append(STRFTIME[form[i + 1]])
            i += 2
        else:
            text += form[i]
            i += 1
    literal()
    return "".join(out)


@builds("validate_date_format")
def _date_format(ctx: Context, rule: RuleDefinition) -> Column:
    c = _col(_one(rule))
    parsed = c.try_cast("date") if not rule.value else F.try_to_timestamp(c.cast("string"), F.lit(java_pattern(str(rule.value))))
    return F.when(c.isNotNull(), parsed.isNull())


@builds("all_date_checks")
def _all_dates(ctx: Context, rule: RuleDefinition) -> Column:
    """Fails unless the value is a date, not in the future and not before 1900."""
    c, d = _col(_one(rule)), _day(ctx, _one(rule))
    return F.when(c.isNotNull(), d.isNull() | (d > ctx.as_of) | (d < F.lit(FIRST_DATE)))


@builds("satisfies")
def _satisfies(ctx: Context, rule: RuleDefinition) -> Column:
    if not rule.value or not isinstance(rule.value, str):
        raise RuleError("the check needs a condition")
    return ~F.expr(f"({rule.value})")


def register_rule(check_type: str, build: Callable[[Context, RuleDefinition], Column], category: str = "custom") -> None:
    """Add a row check of one's own: build gives the column that is true where a row fails."""
    MANIFEST[check_type] = Check(check_type, "ROW", category)
    _BUILD[check_type] = build


@dataclass(frozen=True)
class TableRule:
    """A table check of the user's own: its aggregate, and what its figure is judged by (None: as those of the library)."""

    figure: Callable[[Context, RuleDefinition, Column], Column]
    meets: Callable[[Any, RuleDefinition], bool] | None = None


TABLE_RULES: dict[str, TableRule] = {}


def register_table_rule(check_type: str, figure: Callable[[Context, RuleDefinition, Column], Column], meets: Callable[[Any, RuleDefinition], bool] | None = None, category: str = "custom") -> None:
    """Add a table check of one's own. figure gives an aggregate column, which is measured in the same pass as all others.

    figure's third argument is true for rows that count (those of the rule's filter). meets takes the measured figure, as a number if it is
    one, else as text, None for nothing, and the rule; without it the figure has to be within threshold * |value| of the value.
    """
    MANIFEST[check_type] = Check(check_type, "TABLE", category)
    TABLE_RULES[check_type] = TableRule(figure, meets)


def unregister_rule(check_type: str) -> None:
    """Take back a check of one's own."""
    for known in (MANIFEST, _BUILD, TABLE_RULES):
        known.pop(check_type, None)


def table_figure(ctx: Context, rule: RuleDefinition) -> Column:
    """The aggregate of a table check of the user's own."""
    missing = [f for f in rule.fields if f and f != "*" and f not in ctx.schema.fieldNames()]
    if missing:
        raise RuleError(f"there is no field '{missing[0]}'")
    rows = F.coalesce(F.expr(f"({rule.filter})"), F.lit(False)) if rule.filter else F.lit(True)
    return TABLE_RULES[rule.canonical].figure(ctx, rule, rows)


def fail_predicate(ctx: Context, rule: RuleDefinition, null_policy: str = "skip") -> Column:
    """True where the row fails, never NULL. Rows that can't be judged pass under "skip" and fail under "fail"."""
    if null_policy not in ("skip", "fail"):
        raise ValueError("null_policy is 'skip' or 'fail'")
    name = rule.canonical
    if name not in _BUILD:
        raise RuleError(f"no predicate for '{rule.check_type}'")
    missing = [f for f in rule.fields if f not in ctx.schema.fieldNames() and not (f == "*" and name == "satisfies")]
    if missing and not (name == "satisfies" and rule.label == ""):
        raise RuleError(f"there is no field '{missing[0]}'")
    failed = F.coalesce(_BUILD[name](ctx, rule), F.lit(null_policy == "fail" and name not in NULL_FAILS))
    return failed & F.coalesce(F.expr(f"({rule.filter})"), F.lit(False)) if rule.filter else failed
