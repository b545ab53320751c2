"""Validation and split in one pass: figures are observed while the rows are written."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.planner import ValidationPlan, bind, entry
from ..report import ValidationReport
from ..rules import RuleDefinition
from .bifurcate import ERRORS, annotate
from .validate import measure, report_of

#: The folder of a row: it breaks no rule; one that fails for any row; only such as pass up to a share, which is known in the end.
PART = "_dq_part"
GOOD, BAD, OPEN = "good", "bad", "open"


@dataclass
class ObservedValidation:
    """A report, and the stored rows that break no failed rule and those that do, the latter with the failed rules that they break."""

    report: ValidationReport
    good: DataFrame
    bad: DataFrame
    path: str


def _observable(plan: ValidationPlan) -> list[int]:
    """Rules whose figures can be observed: all but exact distinct counts, entropy and information gain, which need a grouping."""
    return [i for i, b in enumerate(plan.bound) if b.error is None and (b.kind in ("row", "unique") or (b.kind == "aggregate" and (plan.approx or b.rule.canonical != "has_cardinality")))]


def _write(plan: ValidationPlan, path: str, mode: str, file_format: str) -> tuple[dict[int, Any], StructType]:
    """Write all rows in one job; what was observed, as rows of METRIC_SCHEMA by rule number, and the columns that were written."""
    own = plan.only(_observable(plan))
    rows = annotate(plan, None)
    figures = own.entries(own.measures())

    def breaks(ids: Sequence[str]) -> Column:
        return F.exists(ERRORS, lambda e: e.rule_id.isin(*ids)) if ids else F.lit(False)

    figures += [entry(i, F.lit(None), F.count_if(breaks([b.rule_id]))) for i, b in enumerate(own.bound) if b.kind == "unique"]
    strict = [b.rule_id for b in plan.bound if b.error is None and (b.rule.threshold is None or b.rule.threshold >= 1)]
    seen = Observation("validation")
    rows = rows.observe(seen, *(c.alias(f"m{k}") for k, c in enumerate(figures)))
    part = F.when(F.size(ERRORS) == 0, GOOD).when(breaks(strict), BAD).otherwise(OPEN)
    parted = rows.withColumn(PART, part)
    parted.write.partitionBy(PART).mode(mode).format(file_format).save(path)
    return {r["i"]: r for r in seen.get.values()}, parted.schema


def validate_and_write(df: DataFrame, rules: Sequence[RuleDefinition], path: str, as_of: date | str | None = None, null_policy: str = "skip", where: str | None = None, approx: bool = False, mode: str = "overwrite", file_format: str = "parquet") -> ObservedValidation:
    """Store all rows of df below path, apart by the rules that they break, and judge the rules by figures gathered on the way.

    One job with one scan, for row rules and aggregates. Each uniqueness rule counts its keys in a job before it; exact distinct counts,
    entropy and information gain take one more pass together. Rows and verdicts are those of validate() and its split(). A row that breaks
    only rules with a threshold below 1 lies in a folder of its own, and counts as good or bad by the verdicts on these.
    A rule that throws on the data becomes an error, and the rows are written again without it.
    """
    plan = bind(df, rules, as_of, null_policy, where, approx)
    while True:
        try:
            found, schema = _write(plan, path, mode, file_format)
            break
        except (PySparkException, Py4JJavaError):
            before = sum(b.error is not None for b in plan.bound)
            measure(plan)
            if sum(b.error is not None for b in plan.bound) == before:
                raise
            mode = "overwrite" if mode == "errorifexists" else mode
    rest = [i for i, b in enumerate(plan.bound) if b.error is None and b.kind in ("aggregate", "entropy", "infogain") and i not in _observable(plan)]
    if rest:
        more = measure(plan.only(rest))
        found |= {i: more[i] for i in more if i in rest or -2 - i in rest}
    report = report_of(plan, found)
    failed = [r.rule_id for r in report.failed]
    stored = df.sparkSession.read.format(file_format).schema(schema).load(path)
    kept = stored.withColumn(ERRORS, F.filter(ERRORS, lambda e: e.rule_id.isin(*failed) if failed else F.lit(False)))
    good = kept.where((F.col(PART) != BAD) & (F.size(ERRORS) == 0)).drop(ERRORS, PART)
    bad = kept.where((F.col(PART) != GOOD) & (F.size(ERRORS) > 0)).drop(PART)
    return ObservedValidation(report, good, bad, path)
