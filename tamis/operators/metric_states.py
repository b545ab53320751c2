"""Mergeable states of rules: what is gathered for a batch, a day or a partition adds up to what one pass over all rows finds.

A state is a row of plain columns: numbers of rows and failures, sums, least and greatest values, counts with means and second moments
about them, sketches of distinct values. Rules on whole keys (uniqueness, entropy, information gain, exact distinct counts) have rows
(set of keys, key, n) instead, a distributed table that is never gathered. merge() is associative and takes states in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import measured_column
from ..plans.planner import BoundRule, ValidationPlan, entry
from ..report import ValidationReport
from .validate import report_of

#: How a part of a state is merged. A second moment needs the common mean, so it is merged after the others.
_MERGE = {"rows": F.sum, "fails": F.sum, "total": F.sum, "n": F.sum, "low": F.min, "high": F.max, "sketch": F.hll_union_agg}


def sketch_size(rsd: float) -> int:
    """Bits of a sketch's registers for a relative standard deviation of distinct counts."""
    return min(21, max(4, ceil(2 * log2(1.04 / rsd))))


def _rows_of(b: BoundRule) -> Column:
    return F.coalesce(F.expr(f"({b.rule.filter})"), F.lit(False)) if b.rule.filter else F.lit(True)


def _keyed(plan: ValidationPlan, rsd: float | None) -> list[tuple[int, tuple[str, ...], str | None, list[int]]]:
    """Rules on whole keys: number, fields, filter, rules. Rules of one entry share its counts. The fields' order matters to no figure.

    Rules with an error have no counts, but the numbers stay as they were before it.
    """
    out: dict[tuple, list[int]] = {}
    for i, b in enumerate(plan.bound):
        if b.kind in ("unique", "entropy", "infogain") or (b.kind == "aggregate" and b.rule.canonical == "has_cardinality" and rsd is None):
            out.setdefault((tuple(sorted(set(b.rule.fields))), b.rule.filter), []).append(i)
    entries = [(k, fields, where, [i for i in members if plan.bound[i].error is None]) for k, ((fields, where), members) in enumerate(out.items())]
    return [e for e in entries if e[3]]


def _parts(plan: ValidationPlan, i: int, b: BoundRule, rsd: float | None) -> dict[str, Column]:
    """The state of a rule, by part."""
    out: dict[str, Column] = {}
    if b.error is not None or b.kind in ("none", "schema"):
        return out
    if b.rule.filter:
        out["rows"] = F.count_if(_rows_of(b))
    if b.kind == "row":
        out["fails"] = F.count_if(b.fails)
    if b.kind != "aggregate":
        return out
    if b.figure is not None:  # a rule of the user's own: how its figure adds up isn't known
        return {}
    name = b.rule.canonical
    c = measured_column(name, b.rule.fields[0], plan.context.kind(b.rule.fields[0]))
    c = F.when(_rows_of(b), c) if b.rule.filter else c
    if name in ("has_min", "has_max"):
        out["low" if name == "has_min" else "high"] = F.min(c) if name == "has_min" else F.max(c)
    elif name == "has_sum":
        out["total"] = F.sum(c)
    elif name in ("has_mean", "has_std"):
        x = c.cast("double")
        out |= {"n": F.count(x), "mean": F.coalesce(F.avg(x), F.lit(0.0))}
        if name == "has_std":
            out["m2"] = F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
    elif name == "has_cardinality" and rsd is not None:
        kind = plan.context.kind(b.rule.fields[0])
        known = isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType))
        out["sketch"] = F.hll_sketch_agg(c if known else c.cast("string"), F.lit(sketch_size(rsd)))
    return out


@dataclass
class MetricStates:
    """States of a plan's rules: one row in totals for each group of `by` (one at all without), and counts of keys, if a rule needs them."""

    plan: ValidationPlan
    totals: DataFrame
    counts: DataFrame | None
    by: tuple[str, ...] = ()
    rsd: float | None = None

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Store the states as Parquet below path."""
        self.totals.write.mode(mode).parquet(f"{path}/totals")
        if self.counts is not None:
            self.counts.write.mode(mode).parquet(f"{path}/counts")

    def read(self, *paths: str) -> MetricStates:
        """States like these that were stored, all paths together; they can be merged."""
        spark = self.totals.sparkSession
        totals = spark.read.schema(self.totals.schema).parquet(*(f"{p}/totals" for p in paths))
        counts = None if self.counts is None else spark.read.schema(self.counts.schema).parquet(*(f"{p}/counts" for p in paths))
        return MetricStates(self.plan, totals, counts, self.by, self.rsd)

    def merge(self, *others: MetricStates, by: Sequence[str] | None = None) -> MetricStates:
        """These and other states of the same rules as one state, or as one for each group of `by`, some of the columns they have."""
        keep = list(self.by if by is None else by)
        totals = reduce(DataFrame.unionByName, (s.totals for s in (self, *others)))
        counts = None if self.counts is None else reduce(DataFrame.unionByName, (s.counts for s in (self, *others)))
        return MetricStates(self.plan, _merged(totals, keep), None if counts is None else counts.groupBy(*keep, "keys", "key").agg(F.sum("n").alias("n")), tuple(keep), self.rsd)

    def metrics(self) -> DataFrame:
        """The rows that ValidationPlan.metrics() gives, from the states of all groups."""
        one = self.merge(by=())
        columns = set(one.totals.columns)
        rows = [entry(-1, F.coalesce("rows", F.lit(0)))]
        for i, b in enumerate(self.plan.bound):
            own = {p: F.col(f"s{i}_{p}") for p in ("rows", "fails", "total", "n", "mean", "m2", "low", "high", "sketch") if f"s{i}_{p}" in columns}
            total = F.coalesce(own["rows"], F.lit(0)) if "rows" in own else F.lit(None)
            if b.kind == "row" and "fails" in own:
                rows.append(entry(i, total, F.coalesce(own["fails"], F.lit(0))))
            elif value := _value(b.rule.canonical, own):
                rows.append(entry(i, total, None, value[0]))
            elif "rows" in own:
                rows.append(entry(-2 - i, total))
        frames = [one.totals.select(F.explode(F.array(*rows)).alias("m")).select("m.*")]
        for k, fields, _, members in _keyed(self.plan, self.rsd):
            frames.append(_of_counts(one.counts.where(F.col("keys") == k), len(fields), [(i, self.plan.bound[i]) for i in members]))
        return reduce(DataFrame.unionByName, frames)

    def report(self) -> ValidationReport:
        """Verdicts of all states together."""
        return report_of(self.plan, {r["i"]: r for r in self.metrics().collect()})


def _value(check: str, own: dict[str, Column]) -> list[Column]:
    """The figure of an aggregate; a list of one, or none."""
    if check == "has_std" and "m2" in own:
        return [F.when(own["n"] > 1, F.sqrt(own["m2"] / (own["n"] - 1)))]
    if check == "has_mean" and "mean" in own:
        return [F.when(own["n"] > 0, own["mean"])]
    if "sketch" in own:
        return [F.coalesce(F.hll_sketch_estimate(own["sketch"]), F.lit(0))]
    return [own[p] for p in ("low", "high", "total") if p in own]


def _merged(totals: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each group: sums first, then second moments about the mean of all: sum(m2) + sum(n * (own mean - mean)^2)."""
    kinds = dict(totals.dtypes)
    parts = [(c, c.partition("_")[2] or c) for c in totals.columns if c == "rows" or (c.startswith("s") and c.partition("_")[2] in {*_MERGE, "mean", "m2"} and c.partition("_")[0][1:].isdigit())]
    sums = [_MERGE[p](c).cast(kinds[c]).alias(c) for c, p in parts if p in _MERGE]
    means = [F.coalesce(F.sum(F.col(c) * F.col(f"{c[:-5]}_n")) / F.nullif(F.sum(f"{c[:-5]}_n"), F.lit(0)), F.lit(0.0)).alias(c) for c, p in parts if p == "mean"]
    first = totals.groupBy(*keep).agg(*sums, *means)
    moments = [c for c, p in parts if p == "m2"]
    if not moments:
        return first
    common = first.select(*(F.col(k).alias(f"__{k}") for k in keep), *(F.col(f"{c[:-3]}_mean").alias(f"__{c}") for c in moments))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keep)) if keep else None
    # Without groups the common means are one row.
    joined = totals.join(common, same) if keep else totals.crossJoin(F.broadcast(common))
    spread = joined.groupBy(*keep).agg(*(F.sum(F.col(c) + F.col(f"{c[:-3]}_n") * F.pow(F.col(f"{c[:-3]}_mean") - F.col(f"__{c}"), 2.0)).alias(c) for c in moments))
    if not keep:
        return first.crossJoin(F.broadcast(spread))
    spread = spread.select(*(F.col(k).alias(f"__{k}") for k in keep), *moments)
    return first.join(spread, same).drop(*(f"__{k}" for k in keep))


def _of_counts(counts: DataFrame, width: int, members: Sequence[tuple[int, BoundRule]]) -> DataFrame:
    """The rows of metrics() for rules on one set of keys; counts has each key once."""
    known = F.forall("key", lambda x: x.isNotNull())
    n = F.when(known, F.col("n").cast("double"))
    entropy = F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)
    figures = counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"), F.count_if(known).alias("groups"), entropy.alias("entropy"))
    rows = []
    for i, b in members:
        if b.kind == "unique":
            rows.append(entry(i, F.lit(None), F.col("duplicates")))
        elif b.kind == "entropy":
            rows.append(entry(i, F.lit(None), None, F.col("entropy")))
        elif b.kind == "aggregate":
            rows.append(entry(i, F.lit(None), None, F.col("groups")))
    frames = [figures.select(F.explode(F.array(*rows)).alias("m")).select("m.*")] if rows else []
    gains = [i for i, b in members if b.kind == "infogain"]
    if gains and width == 2:
        both = counts.where(known).select(F.col("key")[0].alias("x"), F.col("key")[1].alias("y"), "n")
        cube = both.cube("x", "y").agg(F.grouping_id().alias("level"), F.sum("n").cast("double").alias("n"))
        total = F.max(F.when(F.col("level") == 3, F.col("n")))
        spread = {k: F.sum(F.when(F.col("level") == k, F.col("n") * F.log2("n"))) / total for k in (0, 1, 2)}
        gain = cube.agg((F.log2(total) - spread[1] - spread[2] + spread[0]).alias("gain"))
        frames.append(gain.select(F.explode(F.array(*(entry(i, F.lit(None), None, F.col("gain")) for i in gains))).alias("m")).select("m.*"))
    return reduce(DataFrame.unionByName, frames)


def metric_states(plan: ValidationPlan, by: Sequence[str] = (), rsd: float | None = None) -> MetricStates:
    """The states of a plan's rules over its table, one for each group of the columns `by`. Nothing has run yet.

    rsd: distinct counts by a sketch with about this relative standard deviation, instead of counts of all values. All row rules and
    aggregates are one pass; the sets of keys are one grouping more, together.
    """
    measures = {"rows": F.count(F.lit(1))}
    for i, b in enumerate(plan.bound):
        measures |= {f"s{i}_{p}": c for p, c in _parts(plan, i, b, rsd).items()}
    totals = plan.df.groupBy(*by).agg(*(c.alias(k) for k, c in measures.items()))
    keyed = []
    for k, fields, where, _ in _keyed(plan, rsd):
        key = F.array(*(_key_part(f, plan.context.kind(f)) for f in fields))
        keyed.append(F.struct(F.lit(k).alias("keys"), F.when(F.coalesce(F.expr(f"({where})"), F.lit(False)), key).otherwise(F.lit(None)).alias("key") if where else key.alias("key")))
    counts = None
    if keyed:
        rows = plan.df.select(*by, F.explode(F.array(*keyed)).alias("k")).select(*by, "k.keys", "k.key").where("key is not null")
        counts = rows.groupBy(*by, "keys", "key").agg(F.count(F.lit(1)).alias("n"))
    return MetricStates(plan, totals, counts, tuple(by), rsd)


def _key_part(name: str, kind: T.DataType) -> Column:
    """A key's value as text, different for different values."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(kind)  # -0.0 and 0.0 are one key
    return F.to_json(F.struct(c.alias("v"))) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
