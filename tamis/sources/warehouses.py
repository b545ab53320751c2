"""Warehouses by name: where they are, what SQL they speak, tables of theirs as DataFrames, and rules that run there."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from ..operators.pushdown import jdbc_runner, validate_pushed
from ..report import ValidationReport
from ..rules import RuleDefinition
from .tables import load_jdbc

# Address, driver class and dialect of each kind of warehouse. Parts in braces are given by the user, those after = have a default.
_KINDS = {
    "postgres": ("jdbc:postgresql://{host}:{port=5432}/{database}", "org.postgresql.Driver", "postgres"),
    "redshift": ("jdbc:redshift://{host}:{port=5439}/{database}", "com.amazon.redshift.Driver", "redshift"),
    "snowflake": ("jdbc:snowflake://{host}/?db={database}&schema={schema=PUBLIC}&warehouse={warehouse}", "net.snowflake.client.jdbc.SnowflakeDriver", "snowflake"),
    "bigquery": ("jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443;ProjectId={project};OAuthType={auth=3}", "com.simba.googlebigquery.jdbc.Driver", "bigquery"),
    "trino": ("jdbc:trino://{host}:{port=8080}/{catalog}/{schema=default}", "io.trino.jdbc.TrinoDriver", "trino"),
    "athena": ("jdbc:athena://Region={region};OutputLocation={output};Workgroup={workgroup=primary}", "com.amazon.athena.jdbc.AthenaDriver", "athena"),
    "doris": ("jdbc:mysql://{host}:{port=9030}/{database}", "com.mysql.cj.jdbc.Driver", "doris"),
    "derby": ("jdbc:derby:{database}", "org.apache.derby.iapi.jdbc.AutoloadedDriver", "derby"),
}
KINDS = tuple(_KINDS)


def _address(form: str, parts: Mapping[str, str]) -> str:
    """The form with its parts; ValueError for one that is missing or not in it."""
    out, known = [], set()
    for text, name, _, _ in string.Formatter().parse(form):
        out.append(text)
        if name is None:
            continue
        name, _, default = name.partition("=")
        known.add(name)
        value = str(parts.get(name, default))
        if not value:
            raise ValueError(f"the address needs '{name}'")
        out.append(quote(value, safe=":/.@_-") if "&" in form or "?" in form else value)
    if unknown := set(parts) - known:
        raise ValueError(f"the address has no '{min(unknown)}'; it has {', '.join(sorted(known))}")
    return "".join(out)


@dataclass(frozen=True)
class Warehouse:
    """A database that Spark reaches over JDBC. Its driver has to be on Spark's class path."""

    kind: str
    url: str
    driver: str
    dialect: str
    properties: Mapping[str, str] = field(default_factory=dict)

    def _options(self) -> dict[str, str]:
        return {"driver": self.driver, **self.properties}

    def table(self, spark: SparkSession, name: str, key: str | None = None, partitions: int = 16) -> DataFrame:
        """A table of the warehouse, read by that many connections if it has a numeric key."""
        return load_jdbc(spark, self.url, name, key, partitions, self._options())

    def validate(self, spark: SparkSession, table: str, rules: Sequence[RuleDefinition], where: str | None = None, as_of: date | str | None = None, null_policy: str = "skip") -> ValidationReport:
        """Verdicts on a table that stays where it is: one SELECT runs there, one row comes back."""
        return validate_pushed(jdbc_runner(spark, self.url, self._options()), table, rules, self.dialect, where, as_of, null_policy)


def warehouse(kind: str, properties: Mapping[str, str] | None = None, **parts: str) -> Warehouse:
    """A warehouse of one of KINDS from the parts of its address; properties are its driver's, as user and password."""
    if kind not in _KINDS:
        raise ValueError(f"unknown warehouse '{kind}'; there are {', '.join(KINDS)}")
    form, driver, dialect = _KINDS[kind]
    return Warehouse(kind, _address(form, parts), driver, dialect, dict(properties or {}))
