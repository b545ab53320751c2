"""Schema contracts: what columns a table must have, compared with its schema on the driver. No job runs."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names of types that a contract may use, by canonical name.
CANONICAL = {
    "integer": "int int8 int16 int32 int64 integer long bigint tinyint smallint uint8 uint16 uint32 uint64".split(),
    "float": "float float16 float32 float64 double decimal".split(),
    "string": "str string object utf8 utf categorical".split(),
    "boolean": "bool boolean".split(),
    "datetime": "datetime datetime64 timestamp date time".split(),
    "array": "list array".split(),
    "complex": "struct dict map".split(),
}
_BY_NAME = {name: kind for kind, names in CANONICAL.items() for name in (kind, *names)}


def canonical_type(kind: T.DataType | str) -> str:
    """One of seven names, else "unknown"; from a Spark type or the name of a type, parameters left out."""
    if isinstance(kind, str):
        name = kind.strip().lower()
        for end in "[(<":
            name = name.split(end)[0]
        return _BY_NAME.get(name.strip().removesuffix("type").removesuffix("_ntz"), "unknown")
    table = (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"), ((T.FloatType, T.DoubleType, T.DecimalType), "float"), ((T.StringType, T.CharType, T.VarcharType), "string"),
        ((T.BooleanType,), "boolean"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "datetime"), ((T.ArrayType,), "array"), ((T.StructType, T.MapType), "complex"),
    )
    return next((name for classes, name in table if isinstance(kind, classes)), "unknown")


@dataclass
class ColumnDef:
    """A column of a contract: type and, for arrays, the type of elements, for structs its fields."""

    name: str
    type: str = "string"
    nullable: bool = True
    optional: bool = False
    comment: str | None = None
    comment_required: bool = False
    element_type: str | None = None
    fields: list[ColumnDef] = field(default_factory=list)

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> ColumnDef:
        own = {k: data[k] for k in ("name", "nullable", "optional", "comment", "comment_required", "element_type") if k in data}
        return cls(type=str(data.get("type", data.get("data_type", "string"))), fields=[cls.from_dict(f) for f in data.get("fields") or []], **own)


@dataclass
class SchemaDef:
    """A contract. strict: no other columns."""

    columns: list[ColumnDef]
    strict: bool = False

    @classmethod
    def from_dict(cls, data: Mapping[str, Any] | list, strict: bool | None = None) -> SchemaDef:
        columns = data if isinstance(data, list) else data.get("columns", data.get("fields", []))
        own = False if isinstance(data, list) else bool(data.get("strict", False))
        return cls([c if isinstance(c, ColumnDef) else ColumnDef.from_dict(c) for c in columns], own if strict is None else strict)


@dataclass
class SchemaReport:
    """What differs; true if nothing does."""

    missing_columns: list[str] = field(default_factory=list)
    type_errors: dict[str, str] = field(default_factory=dict)
    metadata_errors: dict[str, str] = field(default_factory=dict)
    extra_columns: list[str] = field(default_factory=list)

    @property
    def total_issues(self) -> int:
        return len(self.missing_columns) + len(self.type_errors) + len(self.metadata_errors) + len(self.extra_columns)

    @property
    def passed(self) -> bool:
        return self.total_issues == 0

    def __bool__(self) -> bool:
        return self.passed

    def issues(self) -> list[str]:
        return [*(f"{c}: missing" for c in self.missing_columns), *(f"{c}: {m}" for c, m in (*self.type_errors.items(), *self.metadata_errors.items())), *(f"{c}: not in the contract" for c in self.extra_columns)]

    def to_dict(self) -> dict[str, Any]:
        return {"passed": self.passed, "missing_columns": self.missing_columns, "type_errors": self.type_errors, "metadata_errors": self.metadata_errors, "extra_columns": self.extra_columns, "total_issues": self.total_issues}


def _compare(actual: T.StructType, wanted: list[ColumnDef], prefix: str, strict: bool, out: SchemaReport) -> None:
    own = {f.name: f for f in actual.fields}
    for c in wanted:
        path = f"{prefix}{c.name}"
        if c.name not in own:
            if not c.optional:
                out.missing_columns.append(path)
            continue
        f = own[c.name]
        has, needs = canonical_type(f.dataType), canonical_type(c.type)
        if has != needs and needs != "unknown":  # a name that nobody here knows says nothing of the type
            out.type_errors[path] = f"Expected {needs}, got {has}"
        elif isinstance(f.dataType, T.ArrayType):
            if c.element_type and canonical_type(f.dataType.elementType) != canonical_type(c.element_type):
                out.type_errors[path] = f"Expected elements {canonical_type(c.element_type)}, got {canonical_type(f.dataType.elementType)}"
            elif c.fields and isinstance(f.dataType.elementType, T.StructType):
                _compare(f.dataType.elementType, c.fields, f"{path}.", strict, out)
        elif isinstance(f.dataType, T.StructType) and c.fields:
            _compare(f.dataType, c.fields, f"{path}.", strict, out)
        comment = (f.metadata or {}).get("comment")
        if c.comment_required and not comment:
            out.metadata_errors[path] = "comment missing"
        elif c.comment is not None and comment != c.comment:
            out.metadata_errors[path] = f"Expected comment {c.comment!r}, got {comment!r}"
        elif not c.nullable and f.nullable:
            out.metadata_errors[path] = "Expected NOT NULL, got nullable"
    if strict:
        out.extra_columns += [f"{prefix}{n}" for n in own if n not in {c.name for c in wanted}]


def validate_schema(df: DataFrame | T.StructType, contract: SchemaDef) -> SchemaReport:
    """Compare a table's schema with a contract, nested structs and arrays of them included."""
    out = SchemaReport()
    _compare(df if isinstance(df, T.StructType) else df.schema, contract.columns, "", contract.strict, out)
    return out


def _describe(f: T.StructField) -> dict[str, Any]:
    out: dict[str, Any] = {"name": f.name, "type": canonical_type(f.dataType), "raw_type": f.dataType.simpleString(), "nullable": f.nullable, "comment": (f.metadata or {}).get("comment")}
    kind = f.dataType
    if isinstance(kind, T.ArrayType):
        out["element_type"] = canonical_type(kind.elementType)
        kind = kind.elementType
    if isinstance(kind, T.StructType):
        out["fields"] = [_describe(x) for x in kind.fields]
    return out


def extract_schema(df: DataFrame | T.StructType, as_json: bool = False) -> dict[str, Any] | str:
    """A contract that df meets, as a dictionary or JSON; the opposite of SchemaDef.from_dict."""
    schema = df if isinstance(df, T.StructType) else df.schema
    out = {"columns": [_describe(f) for f in schema.fields]}
    return json.dumps(out, indent=2) if as_json else out
