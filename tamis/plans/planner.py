"""Binding rules to a table's schema, and the fusion of all that can be measured in one pass."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import cached_property, reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import DISTINCT_IN_PASS, aggregate, group_row, information_gain
from ..functions.predicates import TABLE_RULES, Context, RuleError, fail_predicate, table_figure
from ..rules import RuleDefinition

UNIQUE = {"is_unique", "are_unique"}
#: rule number, rows looked at, rows that fail, the measured number, and it as text
METRIC_SCHEMA = "i int, total bigint, fails bigint, number double, text string"


@dataclass
class BoundRule:
    """A rule and how it is measured: "row", "unique", "aggregate", "entropy", "infogain", "schema", or not at all, with the error."""

    rule: RuleDefinition
    rule_id: str
    kind: str
    fails: Column | None = None
    error: str | None = None
    #: The aggregate of a table rule of the user's own.
    figure: Column | None = None


@dataclass
class ValidationPlan:
    """Bound rules over a table. Nothing has run yet."""

    df: DataFrame
    bound: list[BoundRule]
    context: Context
    approx: bool = False
    notes: dict[str, str] = field(default_factory=dict)

    def only(self, members: Collection[int]) -> ValidationPlan:
        """The same plan with all other rules left out; numbers stay."""
        return ValidationPlan(self.df, [b if i in members else BoundRule(b.rule, b.rule_id, "none") for i, b in enumerate(self.bound)], self.context, self.approx)

    def over(self, df: DataFrame) -> ValidationPlan:
        """The same rules, and errors found from now on, over another table of the same schema."""
        return ValidationPlan(df, self.bound, self.context, self.approx)

    @cached_property
    def metrics_frame(self) -> DataFrame:
        return self.metrics()

    def metrics(self) -> DataFrame:
        """One row of METRIC_SCHEMA for each rule that needs data, and one for i = -1 with the table's rows.

        Row checks, aggregates and the row count are one aggregation over one scan. Each set of key columns is one grouping more,
        shared by all rules on it.
        """
        frames = [self._fused()]
        rest = self._late()
        frames += [self._fused(rest[a : a + DISTINCT_IN_PASS]) for a in range(0, len(rest), DISTINCT_IN_PASS)]
        groups: dict[tuple, list[int]] = {}
        for i, b in enumerate(self.bound):
            if b.kind in ("unique", "entropy"):
                groups.setdefault((tuple(sorted(set(b.rule.fields))), b.rule.filter), []).append(i)
            elif b.kind == "infogain":
                row = information_gain(self._rows(b.rule), *b.rule.fields)
                frames.append(row.select(F.lit(i).alias("i"), F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("fails"), F.col("gain").alias("number"), F.col("gain").cast("string").alias("text")))
        for (keys, _), members in groups.items():
            row = group_row(self._rows(self.bound[members[0]].rule), keys)
            entries = [
                F.struct(
                    F.lit(i).alias("i"), F.lit(None).cast("bigint").alias("total"),
                    (F.col("duplicates") if self.bound[i].kind == "unique" else F.lit(None).cast("bigint")).alias("fails"),
                    (F.lit(None).cast("double") if self.bound[i].kind == "unique" else F.col("entropy")).alias("number"),
                    (F.lit(None).cast("string") if self.bound[i].kind == "unique" else F.col("entropy").cast("string")).alias("text"),
                )
                for i in members
            ]
            frames.append(row.select(F.explode(F.array(*entries)).alias("m")).select("m.*"))
        return reduce(DataFrame.unionByName, frames)

    def _rows(self, rule: RuleDefinition) -> DataFrame:
        return self.df.where(rule.filter) if rule.filter else self.df

    def _late(self) -> list[int]:
        """Exact distinct counts beyond those of the fused pass."""
        return [] if self.approx else [i for i, b in enumerate(self.bound) if b.kind == "aggregate" and b.rule.canonical == "has_cardinality"][DISTINCT_IN_PASS:]

    def measures(self, only: Collection[int] | None = None) -> dict[str, Column]:
        """The aggregates of one pass: of all that it can measure, with the table's rows, or of those rules alone."""
        out: dict[str, Column] = {} if only is not None else {"n": F.count(F.lit(1))}
        late = self._late()
        for i, b in enumerate(self.bound):
            if only is not None and i not in only:
                continue
            where = F.coalesce(F.expr(f"({b.rule.filter})"), F.lit(False)) if b.rule.filter and b.kind not in ("none", "schema") else None
            if where is not None and only is None:
                out[f"t{i}"] = F.count_if(where)
            if only is None and i in late:
                continue
            if b.kind == "row":
                out[f"f{i}"] = F.count_if(b.fails)
            elif b.kind == "aggregate":
                name = b.rule.fields[0]
                out[f"a{i}"] = b.figure if b.figure is not None else aggregate(b.rule.canonical, name, self.context.kind(name), self.approx, where)
        return out

    def entries(self, of: Mapping[str, Column], only: Collection[int] | None = None) -> list[Column]:
        """Structs of METRIC_SCHEMA from the columns of measures()."""
        out = [entry(-1, of["n"])] if only is None else []
        for i in range(len(self.bound)):
            total = of.get(f"t{i}", F.lit(None))
            if f"f{i}" in of:
                out.append(entry(i, total, of[f"f{i}"]))
            elif f"a{i}" in of:
                out.append(entry(i, total, None, of[f"a{i}"]))
            elif only is None and f"t{i}" in of:
                out.append(entry(-2 - i, total))
        return out

    def _fused(self, only: Sequence[int] | None = None) -> DataFrame:
        """Everything that one pass can measure; or only those rules."""
        measures = self.measures(only)
        row = self.df.agg(*(c.alias(k) for k, c in measures.items()))
        return row.select(F.explode(F.array(*self.entries({k: F.col(k) for k in measures}, only))).alias("m")).select("m.*")


def entry(i: int, total: Column, fails: Column | None = None, value: Column | None = None) -> Column:
    """A struct of METRIC_SCHEMA; value is the measured figure."""
    none = F.lit(None)
    text = none if value is None else value.cast("string")
    return F.struct(
        F.lit(i).alias("i"), total.cast("bigint").alias("total"), (none if fails is None else fails).cast("bigint").alias("fails"),
        text.try_cast("double").alias("number"), text.cast("string").alias("text"),
    )


def today(as_of: date | str | None) -> Column:
    """The day that counts as today: a given one, else the current date."""
    return F.current_date() if as_of is None else F.lit(date.fromisoformat(as_of) if isinstance(as_of, str) else as_of)


def told(e: Exception) -> str:
    """The first line of what an exception says."""
    text = e.java_exception.toString() if isinstance(e, Py4JJavaError) else str(e)
    return f"Error: {(text.strip().splitlines() or [type(e).__name__])[0]}"


def bind(df: DataFrame, rules: Sequence[RuleDefinition], as_of: date | str | None = None, null_policy: str = "skip", where: str | None = None, approx: bool = False) -> ValidationPlan:
    """Rules bound to df's schema. A rule that can't be applied, for whatever reason, is kept with its error and disturbs no other."""
    if null_policy not in ("skip", "fail"):
        raise ValueError("null_policy is 'skip' or 'fail'")
    if where:
        df = df.where(where)
    context = Context(df.schema, today(as_of))
    bound = []
    for i, rule in enumerate(rules):
        rule_id = f"{i}:{rule.key}"
        if not rule.execute:
            bound.append(BoundRule(rule, rule_id, "none", error="Skipped: execute=False"))
            continue
        try:
            if rule.canonical == "has_pattern":
                df.sparkSession._jvm.java.util.regex.Pattern.compile(str(rule.value))
            bound.append(_bind_one(context, rule, rule_id, null_policy))
        except Exception as e:  # a rule's own builder may raise anything
            bound.append(BoundRule(rule, rule_id, "none", error=told(e)))
    plan = ValidationPlan(df, bound, context, approx)
    try:
        _ = plan.metrics_frame
    except Exception:
        # Some rule does not fit the table's types or names: each is analysed by itself, nothing runs.
        for i, b in enumerate(bound):
            try:
                plan.only({i}).metrics()
            except Exception as e:
                bound[i] = BoundRule(b.rule, b.rule_id, "none", error=told(e))
        plan = ValidationPlan(df, bound, context, approx)
    return plan


def _bind_one(context: Context, rule: RuleDefinition, rule_id: str, null_policy: str) -> BoundRule:
    name = rule.canonical
    if name == "validate_schema":
        return BoundRule(rule, rule_id, "schema")
    if name in TABLE_RULES:
        return BoundRule(rule, rule_id, "aggregate", figure=table_figure(context, rule))
    if rule.level == "ROW" and name not in UNIQUE:
        return BoundRule(rule, rule_id, "row", fail_predicate(context, rule, null_policy))
    missing = [f for f in rule.fields if f not in context.schema.fieldNames()]
    if missing or not rule.fields or not rule.fields[0]:
        raise RuleError(f"there is no field '{missing[0] if missing else ''}'")
    if name in UNIQUE:
        return BoundRule(rule, rule_id, "unique")
    if name == "has_infogain":
        if len(rule.fields) != 2:
            raise RuleError("the check needs two fields")
        return BoundRule(rule, rule_id, "infogain")
    if name == "has_entropy":
        return BoundRule(rule, rule_id, "entropy")
    if len(rule.fields) != 1:
        raise RuleError("the check needs one field")
    return BoundRule(rule, rule_id, "aggregate")
