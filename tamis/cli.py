"""Command line: validate a file, print the rules' SQL or the DDL of the rule tables, profile a file.

    python -m tamis validate data.parquet rules.csv --quarantine bad.parquet --fail-on-error
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators.profile import profile
from .operators.schema_contract import SchemaDef, extract_schema, validate_schema
from .operators.validate import validate
from .plans import ddl, sqlgen
from .report import ValidationReport
from .rules import MANIFEST
from .sources.rules_store import load_rules_csv
from .sources.tables import load_data, save_data


def _table(report: ValidationReport) -> str:
    rows = [("STATUS", "CHECK", "FIELD", "PASS RATE", "MESSAGE")]
    rows += [(r.status.value, r.check_type, r.field, "-" if r.pass_rate is None else f"{r.pass_rate:.4f}", r.message or "") for r in report]
    widths = [max(len(row[i]) for row in rows) for i in range(5)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in rows]
    return "\n".join([*lines, f"{len(report.passed)} passed, {len(report.failed)} failed, {len(report.errors)} errors over {report.total_rows} rows"])


def _validate(args: argparse.Namespace) -> int:
    spark = SparkSession.builder.getOrCreate()
    report = validate(load_data(spark, args.data), load_rules_csv(args.rules), as_of=args.as_of, null_policy=args.null_policy)
    told = json.dumps(report.summary(), indent=2, default=str) if args.format == "json" else _table(report)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(told + "\n")
    else:
        print(told)
    if args.quarantine or args.good:
        good, bad = report.split(persist=bool(args.quarantine and args.good))
        for df, path in ((good, args.good), (bad, args.quarantine)):
            if path:
                save_data(df, path)
    return int(args.fail_on_error and report.pass_rate < 1)


def _sql(args: argparse.Namespace) -> int:
    print(sqlgen.get_validation_sql(load_rules_csv(args.rules), args.table, args.dialect, args.where))
    return 0


def _ddl(args: argparse.Namespace) -> int:
    print(ddl.generate(args.table, args.dialect, args.schema))
    return 0


def _rules(args: argparse.Namespace) -> int:
    for c in MANIFEST.values():
        print(f"{c.name:26}{c.level:7}{c.category:13}{c.alias_of or ''}".rstrip())
    return 0


def _profile(args: argparse.Namespace) -> int:
    print(json.dumps(profile(load_data(SparkSession.builder.getOrCreate(), args.data), args.sample), indent=2, default=str))
    return 0


def _schema(args: argparse.Namespace) -> int:
    df = load_data(SparkSession.builder.getOrCreate(), args.data)
    if not args.contract:
        print(extract_schema(df, as_json=True))
        return 0
    with open(args.contract, encoding="utf-8") as f:
        found = validate_schema(df, SchemaDef.from_dict(json.load(f)))
    print(json.dumps(found.to_dict(), indent=2))
    return int(not found)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tamis", description="Data quality on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for names, options in arguments:
            p.add_argument(*names.split(), **options)

    command(
        "validate", _validate, ("data", {}), ("rules", {}), ("--format", {"choices": ("table", "json"), "default": "table"}), ("--output -o", {}), ("--quarantine", {}), ("--good", {}),
        ("--as-of", {}), ("--null-policy", {"choices": ("skip", "fail"), "default": "skip"}), ("--fail-on-error", {"action": "store_true"}),
    )
    command("sql", _sql, ("rules", {}), ("--table", {"required": True}), ("--dialect", {"default": "spark"}), ("--where", {}))
    command("ddl", _ddl, ("--table", {"default": "all"}), ("--dialect", {"default": "spark"}), ("--schema", {}))
    command("rules", _rules)
    command("profile", _profile, ("data", {}), ("--sample", {"type": float}))
    command("schema", _schema, ("data", {}), ("--contract", {}))
    return top


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (OSError, ValueError, NotImplementedError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
