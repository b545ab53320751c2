"""Rules from CSV files, tables and dictionaries, and back to CSV."""

from __future__ import annotations

import csv
import dataclasses
import json
from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from ..rules import RuleDefinition, parse_value

COLUMNS = ("field", "check_type", "value", "threshold", "level", "category", "execute", "filter", "updated_at")


def check_rules_columns(df: Any) -> None:
    """A rules table needs field and check_type; other columns are welcome."""
    if not hasattr(df, "columns"):
        raise TypeError(f"not a table: {type(df).__name__}")
    missing = {"field", "check_type"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")


def check_rule_dict(rule: Any) -> None:
    """A rule's dictionary needs field and check_type, neither empty."""
    if not isinstance(rule, Mapping):
        raise TypeError(f"not a dictionary: {type(rule).__name__}")
    for name in ("field", "check_type"):
        value = rule.get(name)
        if not value or (isinstance(value, str) and not value.strip()):
            raise ValueError(f"'{name}' is missing or empty")


def _cell(text: str) -> tuple[Any, bool]:
    """The value, and whether it was JSON and so needs no parsing; else it is text, which the rule parses."""
    try:
        return json.loads(text), True
    except ValueError:
        return text, False


def _rule(row: Mapping[str, str]) -> RuleDefinition:
    rule = RuleDefinition.from_dict(row)
    value, exact = _cell(row["value"]) if "value" in row else (None, False)
    return dataclasses.replace(rule, value=value) if exact and isinstance(value, str) else RuleDefinition.from_dict({**row, "value": value})


def load_rules_csv(path: str | Path, delimiter: str = ",") -> list[RuleDefinition]:
    """Rules of a CSV file with a header, of which field and check_type have to be there. Empty cells are left out."""
    with open(path, newline="", encoding="utf-8") as f:
        reader = csv.DictReader(f, delimiter=delimiter)
        missing = {"field", "check_type"} - set(reader.fieldnames or ())
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        return [_rule({k: v for k, v in row.items() if k and v not in (None, "")}) for row in reader]


def _text(value: Any) -> str:
    """A cell. Text that would be read as something else is put into JSON quotes, as are lists."""
    if value is None:
        return ""
    if isinstance(value, str):
        return json.dumps(value) if value != parse_value(value) or _cell(value)[1] else value
    if isinstance(value, (list, tuple, dict, bool)):
        return json.dumps(value, default=str)
    return value.isoformat() if isinstance(value, (date, datetime)) else str(value)


def save_rules_csv(rules: Iterable[RuleDefinition], path: str | Path, delimiter: str = ",") -> None:
    """A file that load_rules_csv reads back to the same rules. Metadata are further columns; their values come back as text."""
    rules = list(rules)
    extra = sorted({k for r in rules for k in r.metadata} - set(COLUMNS))
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, delimiter=delimiter)
        writer.writerow([*COLUMNS, *extra])
        for r in rules:
            field = r.field if isinstance(r.field, str) else f"[{','.join(r.field)}]"
            plain = {c: getattr(r, c) for c in COLUMNS[1:]}
            cells = [_text(v) if c == "value" else "" if v is None else v.isoformat() if isinstance(v, datetime) else str(v) for c, v in plain.items()]
            writer.writerow([field, *cells, *("" if (v := r.metadata.get(k)) is None else str(v) for k in extra)])


def load_rules(df: DataFrame | Sequence[Mapping[str, Any]]) -> list[RuleDefinition]:
    """Rules of a table or of dictionaries. A rules table is small; its rows come to the driver."""
    if isinstance(df, DataFrame):
        check_rules_columns(df)
        rows: Iterable[Mapping[str, Any]] = (r.asDict(recursive=True) for r in df.toLocalIterator())
    else:
        rows = df
    out = []
    for row in rows:
        check_rule_dict(row)
        out.append(RuleDefinition.from_dict({k: v for k, v in row.items() if v is not None}))
    return out
