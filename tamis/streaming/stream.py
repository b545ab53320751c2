"""Validation of streams: rules annotate rows, good and bad rows go to two sinks, and table rules are answered by batch and in total."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from hashlib import sha256

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bifurcate import ERRORS, annotate, split
from ..operators.metric_states import MetricStates, metric_states
from ..operators.validate import measure
from ..plans.planner import BoundRule, ValidationPlan, bind
from ..report import ValidationLevel, ValidationReport, ValidationResult, ValidationStatus
from ..rules import RuleDefinition
from ..sources.store import names, read_json, write_json

_STATEFUL = ("unique", "aggregate", "entropy", "infogain")


def _key(rule: RuleDefinition) -> str:
    """Tells a rule from others, and from itself once it has been mended."""
    return sha256(repr((rule.check_type, rule.fields, rule.value, rule.filter)).encode()).hexdigest()[:24]


@dataclass
class StreamValidation:
    """An annotated stream, and an error for each rule that it can't have or that threw on its rows.

    A batch in whose rows a rule throws is tried again without that rule, which stays off from then on, also after a restart from the same
    checkpoint: its error is kept below it. `df` by itself, read by a query of the user's own, has no such guard.
    """

    df: DataFrame
    plan: ValidationPlan
    errors: list[ValidationResult]
    totals: bool = False

    def split(self) -> tuple[DataFrame, DataFrame]:
        """Two streams, each a query of its own over the source."""
        return split(self.df)

    def write(self, good: str, bad: str, checkpoint: str, file_format: str = "parquet", available_now: bool = True) -> StreamingQuery:
        """One query with both sinks: each batch is computed once, kept, and written twice.

        Files of a batch are in a folder of its number, overwritten if the batch is tried again. A batch counts as written once both sinks
        have it; read_committed reads those alone, so that nobody sees good rows of a batch without its bad ones.
        """

        def both(good_rows: DataFrame, bad_rows: DataFrame, number: int) -> None:
            for part, path in ((good_rows, good), (bad_rows, bad)):
                part.write.mode("overwrite").format(file_format).save(f"{path}/batch={number}")

        return self.for_each(both, checkpoint, available_now)

    def for_each(self, handle: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """One query that gives each batch's good and bad rows and its number to handle; a batch is computed once.

        A batch that handle and the states have got is never given to handle again.
        """
        checkpoint = checkpoint.rstrip("/")

        def each(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            if number <= _last(spark, checkpoint):
                return
            self._recall(spark, checkpoint)
            kept = self._guarded(batch, number, checkpoint)
            try:
                handle(*split(kept), number)
                if self.totals:
                    self._states(batch, number, checkpoint)
            finally:
                kept.unpersist()
            write_json(spark, f"{checkpoint}/tamis/committed", number)

        writer = self.plan.df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def report(self, spark: SparkSession, checkpoint: str, batch: int | None = None) -> ValidationReport:
        """Verdicts on one batch, or on all that are committed, for a stream with totals."""
        checkpoint = checkpoint.rstrip("/")
        done = [int(n.partition("=")[2]) for n in names(spark, f"{checkpoint}/tamis/states")]
        wanted = [n for n in done if n <= _last(spark, checkpoint) and batch in (None, n)]
        self._recall(spark, checkpoint)
        empty = metric_states(self.plan.over(spark.createDataFrame([], self.plan.df.schema)))
        found = empty.read(*(f"{checkpoint}/tamis/states/batch={n}" for n in wanted)) if wanted else empty
        return found.report()

    def _guarded(self, batch: DataFrame, number: int, checkpoint: str) -> DataFrame:
        """The batch, annotated and kept. Rules that throw are found in halves, switched off, and the batch annotated again without them."""
        plan = self.plan.over(batch)
        while True:
            kept = annotate(plan.only([i for i, b in enumerate(plan.bound) if b.kind == "row"]), None).persist()
            try:
                kept.write.format("noop").mode("overwrite").save()
                return kept
            except (PySparkException, Py4JJavaError):
                kept.unpersist()
                if not self._switch_off(plan.only([i for i, b in enumerate(plan.bound) if b.kind == "row"]), number, checkpoint):
                    raise

    def _states(self, batch: DataFrame, number: int, checkpoint: str) -> MetricStates:
        """The batch's states, stored below the checkpoint."""
        plan = self.plan.over(batch)
        while True:
            states = metric_states(plan)
            try:
                states.write(f"{checkpoint}/tamis/states/batch={number}")
                return states
            except (PySparkException, Py4JJavaError):
                if not self._switch_off(plan.over(batch), number, checkpoint):
                    raise

    def _switch_off(self, plan: ValidationPlan, number: int, checkpoint: str) -> bool:
        """Find the rules that throw on the plan's table and keep their errors; whether there are any."""
        before = {b.rule_id for b in plan.bound if b.error}
        measure(plan)
        guilty = [b for b in plan.bound if b.error and b.rule_id not in before]
        for b in guilty:
            write_json(plan.df.sparkSession, f"{checkpoint}/tamis/rules/{_key(b.rule)}", {"rule_id": b.rule_id, "error": b.error, "batch": number})
        self._note(guilty)
        return bool(guilty)

    def _recall(self, spark: SparkSession, checkpoint: str) -> None:
        """Switch off the rules that threw before."""
        off = set(names(spark, f"{checkpoint}/tamis/rules"))
        found = [b for b in self.plan.bound if b.error is None and _key(b.rule) in off]
        for b in found:
            b.error = read_json(spark, f"{checkpoint}/tamis/rules/{_key(b.rule)}")["error"]
        self._note(found)

    def _note(self, bound: Sequence[BoundRule]) -> None:
        known = {e.rule_id for e in self.errors}
        self.errors += [_error(b) for b in bound if b.rule_id not in known]


def _last(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that both sinks have; batches come one after the other."""
    return read_json(spark, f"{checkpoint}/tamis/committed", -1)


def read_committed(spark: SparkSession, path: str, checkpoint: str, file_format: str = "parquet") -> DataFrame:
    """The rows of a sink of StreamValidation.write, of batches that the other sink has too; `batch` is their number."""
    found = spark.read.format(file_format).load(path)
    return found.where(F.col("batch") <= _last(spark, checkpoint.rstrip("/")))


def _error(b: BoundRule) -> ValidationResult:
    return ValidationResult(b.rule_id, ValidationLevel(b.rule.level), b.rule.category, b.rule.check_type, b.rule.label, ValidationStatus.ERROR, message=b.error)


def validate_stream(df: DataFrame, rules: Sequence[RuleDefinition], as_of: date | str | None = None, null_policy: str = "skip", where: str | None = None, totals: bool = False) -> StreamValidation:
    """Annotate a stream (or a table) with all rules that it breaks. No rule is left out silently.

    Table and uniqueness rules become errors, as a stream has no totals; with totals=True the query that writes the stream keeps states
    of all rules instead, and report() answers them for a batch or for all so far.
    """
    plan = bind(df, rules, as_of, null_policy, where)
    for b in plan.bound:
        if b.error is None and b.kind != "row" and not (totals and b.kind in _STATEFUL and b.figure is None):
            b.error = "Error: the check needs totals, which a stream has not" if not totals else "Error: the check has no state that could be kept"
    rows = plan.only([i for i, b in enumerate(plan.bound) if b.kind == "row"])
    return StreamValidation(annotate(rows, None), plan, [_error(b) for b in plan.bound if b.error], totals)


def windowed_metrics(
    df: DataFrame, rules: Sequence[RuleDefinition], time_col: str, window: str | None, watermark: str, as_of: date | str | None = None, null_policy: str = "skip", slide: str | None = None, session_gap: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Rows and failures of each row rule by time window: window_start, window_end, total_rows, and fails as a map by rule id.

    Windows of a fixed length follow each other, or overlap if they begin every slide. With session_gap instead, a window is a session: rows
    of one group of `by` of which none comes session_gap or more after the one before; it ends that much after its last row.
    On a stream, windows are given when the watermark has passed them; rows that come later are left out here, and count_late counts them.
    """
    if (window is None) == (session_gap is None):
        raise ValueError("either a window or a session's gap is needed")
    if df.isStreaming:  # a watermark needs an instant; times without a zone count as the session's
        df = df.withColumn(time_col, F.col(time_col).cast("timestamp"))
    plan = bind(df, rules, as_of, null_policy)
    rows = [b for b in plan.bound if b.kind == "row" and not b.error]
    source = plan.df.withWatermark(time_col, watermark) if plan.df.isStreaming else plan.df
    at = F.session_window(F.col(time_col), session_gap) if session_gap else F.window(F.col(time_col), window, slide)
    grouped = source.groupBy(*by, at.alias("w")).agg(F.count(F.lit(1)).alias("total_rows"), *(F.count_if(b.fails).alias(f"f{i}") for i, b in enumerate(rows)))
    pairs: list[Column] = reduce(list.__add__, ([F.lit(b.rule_id), F.col(f"f{i}")] for i, b in enumerate(rows)), [])
    return grouped.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_rows", F.create_map(*pairs).alias("fails"))


__all__ = ["ERRORS", "StreamValidation", "read_committed", "validate_stream", "windowed_metrics"]
