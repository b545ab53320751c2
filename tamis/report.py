"""What a validation returns: a verdict for each rule, and the table with its errors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from enum import Enum
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .plans.planner import ValidationPlan


class ValidationLevel(Enum):
    ROW = "ROW"
    TABLE = "TABLE"


class ValidationStatus(Enum):
    PASS = "PASS"
    FAIL = "FAIL"
    ERROR = "ERROR"


RESULT_SCHEMA = "rule_id string, level string, category string, check_type string, field string, status string, pass_rate double, expected string, actual string, fail_count bigint, total_rows bigint, message string"


def _now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class ValidationResult:
    """The verdict on one rule."""

    rule_id: str
    level: ValidationLevel
    category: str
    check_type: str
    field: str
    status: ValidationStatus
    pass_rate: float | None = None
    expected: Any = None
    actual: Any = None
    fail_count: int | None = None
    total_rows: int | None = None
    message: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    timestamp: datetime = field(default_factory=_now)

    def to_row(self) -> tuple:
        text = lambda v: None if v is None else str(v)
        return (
            self.rule_id, self.level.value, self.category, self.check_type, self.field, self.status.value, self.pass_rate,
            text(self.expected), text(self.actual), self.fail_count, self.total_rows, self.message,
        )


@dataclass
class ValidationReport:
    """Verdicts in the order of the rules. Behaves as a list of them; the table's rows stay where they are until asked for."""

    results: list[ValidationResult]
    total_rows: int
    execution_time_ms: float
    plan: ValidationPlan | None = None
    engine: str = "spark"
    generated_sql: str | None = None
    timestamp: datetime = field(default_factory=_now)

    def __len__(self) -> int:
        return len(self.results)

    def __iter__(self) -> Iterator[ValidationResult]:
        return iter(self.results)

    def __getitem__(self, i: int) -> ValidationResult:
        return self.results[i]

    def _of(self, status: ValidationStatus) -> list[ValidationResult]:
        return [r for r in self.results if r.status is status]

    @property
    def passed(self) -> list[ValidationResult]:
        return self._of(ValidationStatus.PASS)

    @property
    def failed(self) -> list[ValidationResult]:
        return self._of(ValidationStatus.FAIL)

    @property
    def errors(self) -> list[ValidationResult]:
        return self._of(ValidationStatus.ERROR)

    @property
    def pass_rate(self) -> float:
        """Share of rules that passed; an error is no pass. 1 without rules."""
        return len(self.passed) / len(self.results) if self.results else 1.0

    @property
    def df(self) -> DataFrame:
        """All rows, annotated with the failed rules that they break; a lazy plan."""
        return self.get_validated_df()

    def get_validated_df(self, mode: str = "failed_rules") -> DataFrame:
        from .operators.bifurcate import annotate

        if self.plan is None:
            raise ValueError("the report has no table")
        failed = {r.rule_id for r in self.failed}
        return annotate(self.plan, None if mode == "all_rules" else failed)

    def split(self, mode: str = "failed_rules", persist: bool = False) -> tuple[DataFrame, DataFrame]:
        """Rows that break no failed rule, as they were, and the other rows with _dq_errors. Together they are the input."""
        from .operators.bifurcate import split

        return split(self.get_validated_df(mode), persist)

    def get_good_df(self) -> DataFrame:
        return self.split()[0]

    def get_bad_df(self) -> DataFrame:
        return self.split()[1]

    def to_df(self, spark: SparkSession | None = None) -> DataFrame:
        """The verdicts as a table of RESULT_SCHEMA."""
        spark = spark or (self.plan.df.sparkSession if self.plan else SparkSession.active())
        return spark.createDataFrame([r.to_row() for r in self.results], RESULT_SCHEMA)

    def summary(self, max_sample_ids: int = 100, key_columns: list[str] | None = None) -> dict[str, Any]:
        """A small dictionary for other systems. With key_columns, keys of some rows that break each failed row rule."""
        samples = self._samples(key_columns, max_sample_ids)
        return {
            "timestamp": self.timestamp.isoformat(), "engine": self.engine, "total_rows": self.total_rows, "execution_time_ms": self.execution_time_ms,
            "total_validations": len(self.results), "passed": len(self.passed), "failed": len(self.failed), "errors": len(self.errors), "pass_rate": self.pass_rate,
            "validations": [
                {
                    "rule_id": r.rule_id, "check_type": r.check_type, "field": r.field, "category": r.category, "level": r.level.value, "status": r.status.value,
                    "pass_rate": r.pass_rate, "expected": r.expected, "actual": r.actual, "message": r.message, "fail_count": r.fail_count or 0,
                    "sample_violating_ids": samples.get(r.rule_id, []),
                }
                for r in self.results
            ],
        }

    def _samples(self, keys: list[str] | None, n: int) -> dict[str, list[Any]]:
        """Keys of n rows at most that break each failed row rule, the least ones, from one pass over the table."""
        from .operators.bifurcate import annotate

        failed = {r.rule_id for r in self.results if r.level is ValidationLevel.ROW and r.status is ValidationStatus.FAIL}
        if not keys or n <= 0 or self.plan is None or not failed:
            return {}
        broken = annotate(self.plan, failed).select(F.explode("_dq_errors.rule_id").alias("__rule"), F.struct(*keys).alias("__key"))
        # The limit on ranks goes before the shuffle too: a task passes n rows a rule on at most.
        rank = F.row_number().over(Window.partitionBy("__rule").orderBy("__key"))
        rows = broken.withColumn("__at", rank).where(F.col("__at") <= n).groupBy("__rule").agg(F.sort_array(F.collect_list("__key")).alias("keys")).collect()
        return {r["__rule"]: [k[0] if len(keys) == 1 else tuple(k) for k in r["keys"]] for r in rows}
