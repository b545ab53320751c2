"""CREATE TABLE statements for the tables that hold rules and schema contracts, in many dialects."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple


class Column(NamedTuple):
    name: str
    kind: str  # a key of _KINDS; "text 50" is text of that length
    required: bool
    default: str | None


# The two tables.
_TABLES = {
    "rules": [
        Column("id", "key", required=False, default=None),
        Column("environment", "text 50", required=True, default=None),
        Column("source_type", "text 50", required=True, default=None),
        Column("database_name", "text 255", required=True, default=None),
        Column("catalog_name", "text 255", required=False, default=None),
        Column("schema_name", "text 255", required=False, default=None),
        Column("table_name", "text 255", required=True, default=None),
        Column("field", "text 255", required=True, default=None),
        Column("level", "text 100", required=True, default=None),
        Column("category", "text 100", required=True, default=None),
        Column("check_type", "text 100", required=True, default=None),
        Column("value", "long text", required=False, default=None),
        Column("threshold", "float", required=False, default="1.0"),
        Column("execute", "boolean", required=False, default="TRUE"),
        Column("created_at", "time", required=False, default="CURRENT_TIMESTAMP"),
        Column("updated_at", "time", required=False, default=None),
    ],
    "schema_registry": [
        Column("id", "key", required=False, default=None),
        Column("environment", "text 50", required=True, default=None),
        Column("source_type", "text 50", required=True, default=None),
        Column("database_name", "text 255", required=True, default=None),
        Column("catalog_name", "text 255", required=False, default=None),
        Column("schema_name", "text 255", required=False, default=None),
        Column("table_name", "text 255", required=True, default=None),
        Column("field", "text 255", required=True, default=None),
        Column("data_type", "text 100", required=True, default=None),
        Column("nullable", "boolean", required=False, default="TRUE"),
        Column("max_length", "integer", required=False, default=None),
        Column("comment", "long text", required=False, default=None),
        Column("created_at", "time", required=False, default="CURRENT_TIMESTAMP"),
        Column("updated_at", "time", required=False, default=None),
    ],
}
_KINDS = ("key", "text", "long text", "integer", "float", "boolean", "time")
# Each dialect's types for key, sized text, text, integer, float, boolean and time; {} is a size.
_TYPES = {
    "athena": ("int", "varchar({})", "string", "int", "float", "boolean", "timestamp"),
    "bigquery": ("INT64", "STRING({})", "STRING", "INT64", "FLOAT64", "BOOL", "TIMESTAMP"),
    "clickhouse": ("Int32", "String", "String", "Int32", "Float32", "Bool", "DateTime"),
    "databricks": ("INT", "VARCHAR({})", "STRING", "INT", "FLOAT", "BOOLEAN", "TIMESTAMP"),
    "duckdb": ("INTEGER PRIMARY KEY", "VARCHAR({})", "TEXT", "INTEGER", "REAL", "BOOLEAN", "TIMESTAMP"),
    "hive": ("INT", "VARCHAR({})", "STRING", "INT", "FLOAT", "BOOLEAN", "TIMESTAMP"),
    "mysql": ("INT PRIMARY KEY AUTO_INCREMENT", "VARCHAR({})", "TEXT", "INT", "FLOAT", "BOOLEAN", "TIMESTAMP"),
    "oracle": ("NUMBER GENERATED AS IDENTITY PRIMARY KEY", "VARCHAR2({})", "CLOB", "NUMBER", "BINARY_FLOAT", "NUMBER(1)", "TIMESTAMP"),
    "postgres": ("SERIAL PRIMARY KEY", "VARCHAR({})", "TEXT", "INT", "REAL", "BOOLEAN", "TIMESTAMP"),
    "presto": ("INTEGER", "VARCHAR({})", "VARCHAR", "INTEGER", "REAL", "BOOLEAN", "TIMESTAMP"),
    "redshift": ("INT IDENTITY(1, 1)", "VARCHAR({})", "VARCHAR(MAX)", "INT", "REAL", "BOOLEAN", "TIMESTAMP"),
    "snowflake": ("INT AUTOINCREMENT PRIMARY KEY", "VARCHAR({})", "TEXT", "INT", "FLOAT", "BOOLEAN", "TIMESTAMP"),
    "spark": ("INT", "VARCHAR({})", "STRING", "INT", "FLOAT", "BOOLEAN", "TIMESTAMP"),
    "sqlite": ("INTEGER PRIMARY KEY AUTOINCREMENT", "TEXT({})", "TEXT", "INTEGER", "REAL", "INTEGER", "TIMESTAMP"),
    "teradata": ("INTEGER GENERATED ALWAYS AS IDENTITY", "VARCHAR({})", "CLOB", "INTEGER", "FLOAT", "BYTEINT", "TIMESTAMP"),
    "trino": ("INTEGER", "VARCHAR({})", "VARCHAR", "INTEGER", "REAL", "BOOLEAN", "TIMESTAMP"),
    "tsql": ("INT IDENTITY(1, 1) PRIMARY KEY", "VARCHAR({})", "VARCHAR(MAX)", "INT", "REAL", "BIT", "DATETIME2"),
}
_ALIASES = {"postgresql": "postgres", "mssql": "tsql", "sqlserver": "tsql"}
#: Dialects without column defaults in this form, and without NOT NULL.
_NO_DEFAULT = {"athena", "hive", "presto", "trino", "spark", "databricks"}
_NO_NOT_NULL = {"athena", "hive", "clickhouse"}
_NUMBER_BOOLEAN = {"oracle", "sqlite", "teradata", "tsql"}

_OPTIONS: dict[str, list[tuple[str, Callable[[Any], str]]]] = {
    "bigquery": [("partition_by", lambda v: f"PARTITION BY {v}"), ("cluster_by", lambda v: f"CLUSTER BY {', '.join(v)}")],
    "snowflake": [("cluster_by", lambda v: f"CLUSTER BY ({', '.join(v)})")],
    "redshift": [("distkey", lambda v: f"DISTKEY({v})"), ("sortkey", lambda v: f"SORTKEY({', '.join(v)})")],
    "athena": [("format", lambda v: f"STORED AS {v}"), ("location", lambda v: f"LOCATION '{v}'")],
    "mysql": [("engine", lambda v: f"ENGINE={v}")],
    "spark": [("using", lambda v: f"USING {v}"), ("partition_by", lambda v: f"PARTITIONED BY ({', '.join([v] if isinstance(v, str) else v)})"), ("location", lambda v: f"LOCATION '{v}'")],
}
_OPTIONS["databricks"] = _OPTIONS["spark"]


def list_dialects() -> list[str]:
    return sorted(_TYPES)


def list_tables() -> list[str]:
    return sorted(_TABLES)


def _column(column: Column, dialect: str) -> str:
    kind, size = column.kind, ""
    if kind.startswith("text "):
        kind, size = kind.split()
    text = _TYPES[dialect][_KINDS.index(kind)].format(size)
    if column.default and dialect not in _NO_DEFAULT:
        text += f" DEFAULT {'1' if column.default == 'TRUE' and dialect in _NUMBER_BOOLEAN else column.default}"
    return f"{column.name} {text}" + (" NOT NULL" if column.required and dialect not in _NO_NOT_NULL else "")


def generate(table: str = "all", dialect: str = "spark", schema: str | None = None, **options: Any) -> str:
    """DDL of one table, or of all, for a dialect; options are those of its row in _OPTIONS, e.g. partition_by."""
    dialect = _ALIASES.get(dialect.lower(), dialect.lower())
    if dialect not in _TYPES:
        raise ValueError(f"unknown dialect '{dialect}'; known: {', '.join(list_dialects())}")
    if table != "all" and table not in _TABLES:
        raise ValueError(f"unknown table '{table}'; known: {', '.join(list_tables())}")
    if dialect in ("spark", "databricks"):
        options = {"using": "parquet" if dialect == "spark" else "delta", **options}
    out = []
    for name in list_tables() if table == "all" else [table]:
        columns = ",\n  ".join(_column(c, dialect) for c in _TABLES[name])
        keyword = "CREATE EXTERNAL TABLE" if dialect == "athena" else "CREATE TABLE"
        tail = [form(options[key]) for key, form in _OPTIONS.get(dialect, []) if options.get(key)]
        out.append("\n".join([f"{keyword} {schema + '.' if schema else ''}{name} (\n  {columns}\n)", *tail]))
    return "\n\n".join(out)
