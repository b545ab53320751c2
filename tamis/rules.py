"""Rules: what a user expects of a table. A rule names a check, its field or fields, a value and a threshold."""

from __future__ import annotations

import ast
import dataclasses
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

# The names of the checks with their level, category and the name that an alias stands for.
_MANIFEST = """
is_complete              ROW    completeness
are_complete             ROW    completeness
is_unique                ROW    uniqueness
are_unique               ROW    uniqueness
is_primary_key           ROW    uniqueness   is_unique
is_composite_key         ROW    uniqueness   are_unique
is_equal                 ROW    comparison
is_equal_than            ROW    comparison
is_between               ROW    comparison
is_greater_than          ROW    comparison
is_less_than             ROW    comparison
is_greater_or_equal_than ROW    comparison
is_less_or_equal_than    ROW    comparison
is_positive              ROW    comparison
is_negative              ROW    comparison
is_in_millions           ROW    comparison
is_in_billions           ROW    comparison
is_contained_in          ROW    membership
not_contained_in         ROW    membership
is_in                    ROW    membership   is_contained_in
not_in                   ROW    membership   not_contained_in
has_pattern              ROW    pattern
is_legit                 ROW    pattern
is_today                 ROW    date
is_t_minus_1             ROW    date
is_t_minus_2             ROW    date
is_t_minus_3             ROW    date
is_yesterday             ROW    date         is_t_minus_1
is_past_date             ROW    date
is_future_date           ROW    date
is_date_between          ROW    date
is_date_after            ROW    date
is_date_before           ROW    date
is_on_weekday            ROW    date
is_on_weekend            ROW    date
is_on_monday             ROW    date
is_on_tuesday            ROW    date
is_on_wednesday          ROW    date
is_on_thursday           ROW    date
is_on_friday             ROW    date
is_on_saturday           ROW    date
is_on_sunday             ROW    date
validate_date_format     ROW    date
all_date_checks          ROW    date
satisfies                ROW    sql
has_min                  TABLE  aggregation
has_max                  TABLE  aggregation
has_sum                  TABLE  aggregation
has_mean                 TABLE  aggregation
has_std                  TABLE  aggregation
has_cardinality          TABLE  aggregation
has_entropy              TABLE  aggregation
has_infogain             TABLE  aggregation
validate_schema          TABLE  schema
is_equal_to_column       ROW    comparison   is_equal_than
logic_check              ROW    sql          satisfies
"""


@dataclass(frozen=True)
class Check:
    """An entry of the manifest."""

    name: str
    level: str
    category: str
    alias_of: str | None = None


MANIFEST: dict[str, Check] = {p[0]: Check(*p) for p in map(str.split, _MANIFEST.split("\n")) if p}
_STREAMABLE_NOT = {"uniqueness"}


def canonical(check_type: str) -> str:
    """The check that an alias stands for, else the check itself."""
    return MANIFEST[check_type].alias_of or check_type


def list_rules(level: str | None = None, category: str | None = None, streaming: bool = False) -> list[str]:
    """Names of checks, of a level or category, or of those that need no totals and so work on streams."""
    return [
        c.name for c in MANIFEST.values()
        if level in (None, c.level) and category in (None, c.category) and not (streaming and (c.level == "TABLE" or c.category in _STREAMABLE_NOT))
    ]


def _number(text: str) -> Any:
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text


def parse_value(raw: Any) -> Any:
    """Strings become None, lists, ISO or dd/mm/yyyy dates, numbers, or stay text; other values stay."""
    if isinstance(raw, (list, tuple)):
        return [_number(x.strip(" \"'")) if isinstance(x, str) else x for x in raw]
    if not isinstance(raw, str):
        return raw
    text = raw.strip()
    if text == "" or text.upper() == "NULL":
        return None
    if text[0] == "[" and text[-1] == "]":
        try:
            found = ast.literal_eval(text)
        except (ValueError, SyntaxError):
            found = [x for x in text[1:-1].split(",") if x.strip()]
        return parse_value(found)
    for pattern, form in ((r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"), (r"\d{2}/\d{2}/\d{4}", "%d/%m/%Y")):
        if re.fullmatch(pattern, text):
            try:
                return datetime.strptime(text, form).date()
            except ValueError:
                return text
    return _number(text)


def parse_field(raw: Any) -> str | list[str]:
    """A name or list of names, from a list, "[a,b]", "a,b" or quoted text; one name is not a list."""
    parts = raw if isinstance(raw, (list, tuple)) else str(raw).strip().strip("[]").split(",")
    names = [str(p).strip().strip("\"'").strip() for p in parts]
    names = [n for n in names if n]
    return names[0] if len(names) == 1 else names if names else ""


def parse_timestamp(raw: Any) -> datetime | None:
    if isinstance(raw, datetime) or raw is None:
        return raw
    try:
        return datetime.fromisoformat(str(raw))
    except ValueError:
        return None


# Words of a rules table that mean yes.
_YES = ("true", "1", "yes", "y", "t")


def _share(raw: Any) -> float:
    """A threshold; 1 for what is no number."""
    try:
        return float(raw)
    except (TypeError, ValueError):
        return 1.0


def _yes(raw: Any) -> bool:
    return True if raw is None else raw.strip().lower() in _YES if isinstance(raw, str) else bool(raw)


#: How a rules table's fields are read.
_PARSERS = {"field": lambda v: v or "", "value": parse_value, "threshold": _share, "execute": _yes, "updated_at": parse_timestamp, "filter": lambda v: v or None}


@dataclass(frozen=True)
class RuleDefinition:
    """A check on a field. threshold: least pass rate (ROW) or relative tolerance (TABLE). filter: SQL that limits its rows."""

    field: str | list[str]
    check_type: str
    value: Any = None
    threshold: float | None = 1.0
    level: str | None = None
    category: str | None = None
    execute: bool = True
    updated_at: datetime | None = None
    metadata: Mapping[str, Any] = field(default_factory=dict)
    filter: str | None = None

    def __post_init__(self) -> None:
        check = MANIFEST.get(self.check_type)
        if check is None:
            raise ValueError(f"unknown check_type {self.check_type!r}")
        for name, value in (("field", parse_field(self.field)), ("level", check.level), ("category", check.category)):
            object.__setattr__(self, name, value)

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> RuleDefinition:
        """From a row of any rules table: values are parsed from text, unknown keys become metadata."""
        if not data.get("check_type"):
            raise ValueError("a rule needs a check_type")
        # A condition, a pattern and a format are text, whatever they look like.
        known = MANIFEST.get(data["check_type"])
        text = known is not None and canonical(known.name) in ("satisfies", "has_pattern", "validate_date_format")
        parsers = _PARSERS | ({"value": lambda v: v} if text else {})
        given = {k: parsers[k](data[k]) for k in parsers if k in data}
        own = {f.name for f in dataclasses.fields(cls)} - {"metadata"}
        return cls(check_type=data["check_type"], **({"field": "", "value": None} | given), metadata={k: v for k, v in data.items() if k not in own})

    def to_dict(self) -> dict[str, Any]:
        """Plain values, metadata beside the other keys."""
        out = {f.name: getattr(self, f.name) for f in dataclasses.fields(self) if f.name not in ("metadata", "filter")}
        for key in ("value", "updated_at"):
            if isinstance(out[key], (date, datetime)):
                out[key] = out[key].isoformat()
        return out | ({"filter": self.filter} if self.filter else {}) | dict(self.metadata)

    @property
    def canonical(self) -> str:
        return canonical(self.check_type)

    @property
    def fields(self) -> list[str]:
        return [self.field] if isinstance(self.field, str) else list(self.field)

    @property
    def label(self) -> str:
        """The field or fields as text."""
        return ",".join(self.fields)

    @property
    def key(self) -> str:
        return f"{self.check_type}:{self.label}"
