"""Registered queries of the data-quality operators, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.predicates import register_table_rule, unregister_rule
from .operators.metric_states import metric_states
from .operators.observed import validate_and_write
from .operators.profile import profile_df
from .operators.pushdown import connection_runner, validate_pushed
from .operators.schema_contract import SchemaDef, extract_schema, validate_schema
from .operators.validate import validate
from .plans.planner import bind
from .plans.sqlgen import compile_rules_to_sql
from .plans.transpile import from_spark
from .rules import RuleDefinition as R
from .sources.rules_store import load_rules, load_rules_csv, save_rules_csv
from .sources.scratch import scratch_path
from .streaming.seen import flag_seen, keyed_state
from .streaming.stream import read_committed, validate_stream, windowed_metrics

AS_OF = "1996-06-15"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def verdicts(df: DataFrame, rules: Sequence[R], **options) -> DataFrame:
    """The report of a validation as plain columns."""
    out = validate(df, rules, **options).to_df()
    return out.select("check_type", "field", "status", "fail_count", "total_rows", F.round("pass_rate", 6).alias("pass_rate"))


def row_rules(name: str, table: str, cases: Sequence[tuple[R, str]], source: str | None = None, null_fails: bool = False, where: str | None = None, **options) -> None:
    """Register a report over row rules. cases: each rule with the DuckDB condition under which a row fails it."""
    unknown = "TRUE" if null_fails else "FALSE"
    rows = []
    for rule, fails in cases:
        only = f" FILTER (WHERE {rule.filter})" if rule.filter else ""
        rows.append(f"SELECT '{rule.check_type}' AS check_type, '{rule.label}' AS field, {rule.threshold} AS threshold, count(*) FILTER (WHERE coalesce({fails}, {unknown}) AND {rule.filter or 'TRUE'}) AS fail_count, count(*){only} AS total_rows FROM t")
    ORACLES[name] = f"""
        WITH t AS (SELECT * FROM {source or table}{f' WHERE {where}' if where else ''}), r AS ({" UNION ALL ".join(rows)}),
             p AS (SELECT *, CASE WHEN total_rows = 0 THEN 1.0 ELSE (total_rows - fail_count) / CAST(total_rows AS DOUBLE) END AS rate FROM r)
        SELECT check_type, field, CASE WHEN rate >= threshold THEN 'PASS' ELSE 'FAIL' END AS status, fail_count, total_rows, round(rate, 6) AS pass_rate FROM p"""
    options |= {"where": where} if where else {}
    options |= {"null_policy": "fail"} if null_fails else {}
    sources: dict[str, Callable[[SparkSession, str], DataFrame]] = {"labelled": labelled, "texts": texts_with_gaps, "dates": date_texts}
    key = _SOURCE_OF.get(source or "", "")
    QUERIES[name] = lambda spark, sf_dir: verdicts(sources[key](spark, sf_dir) if key else read(spark, sf_dir, table), [r for r, _ in cases], **options)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, null where there is none."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")


def texts_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a null, a blank and a padded text column."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").withColumns({"status": F.nullif(s, F.lit("P")), "note": F.when(s == "O", F.lit(" \t ")).otherwise(p), "level": F.substring(p, 1, 1)})


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date as text, now and then no date or null."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    bad = F.when(F.col("o_orderkey") % 7 == 0, F.lit("not-a-date")).when(F.col("o_orderkey") % 11 != 0, day)
    return read(spark, sf_dir, "orders").withColumns({"day": bad, "slashed": F.when(F.col("o_orderkey") % 5 == 0, day).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))})


LABELLED = "(SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
TEXTS = "(SELECT *, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderstatus = 'O' THEN ' ' || chr(9) || ' ' ELSE o_orderpriority END AS note, substr(o_orderpriority, 1, 1) AS level FROM orders)"
DATES = """(SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'not-a-date' WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
            CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS slashed FROM orders)"""
_SOURCE_OF = {LABELLED: "labelled", TEXTS: "texts", DATES: "dates"}

COMPLETENESS = [
    (R("quality", "is_complete", threshold=0.3), "quality IS NULL"),
    (R("lang", "is_complete"), "lang IS NULL"),
    (R("quality,toxic", "are_complete"), "quality IS NULL OR toxic IS NULL"),
]
row_rules("row_completeness", "documents", COMPLETENESS, LABELLED)

COMPARISON = [
    (R("l_linenumber", "is_equal", 1, 0.1), "l_linenumber <> 1"),
    (R("l_returnflag", "is_equal", "N"), "l_returnflag <> 'N'"),
    (R("l_discount", "is_equal_than", "l_tax"), "l_discount <> l_tax"),
    (R("l_quantity", "is_between", [5, 45], 0.5), "NOT l_quantity BETWEEN 5 AND 45"),
    (R("l_quantity", "is_greater_than", 10), "l_quantity <= 10"),
    (R("l_quantity", "is_less_than", 40), "l_quantity >= 40"),
    (R("l_discount", "is_greater_or_equal_than", 0.02), "l_discount < 0.02"),
    (R("l_tax", "is_less_or_equal_than", 0.06), "l_tax > 0.06"),
    (R("l_extendedprice", "is_positive"), "l_extendedprice <= 0"),
    (R("l_discount", "is_negative"), "l_discount >= 0"),
    (R("l_extendedprice", "is_in_millions"), "l_extendedprice < 1000000"),
    (R("l_extendedprice", "is_in_billions"), "l_extendedprice < 1000000000"),
    (R("l_shipdate", "is_greater_than", "1995-01-01"), "CAST(l_shipdate AS DATE) <= DATE '1995-01-01'"),
]
row_rules("row_comparison", "lineitem", COMPARISON)
row_rules("row_signs", "customer", [(R("c_acctbal", "is_positive", threshold=0.9), "c_acctbal <= 0"), (R("c_acctbal", "is_negative"), "c_acctbal >= 0")])

MEMBERSHIP = [
    (R("o_orderstatus", "is_contained_in", ["F", "O"], 0.9), "o_orderstatus NOT IN ('F', 'O')"),
    (R("o_orderstatus", "not_contained_in", ["P"]), "o_orderstatus IN ('P')"),
    (R("status", "is_in", ["F"]), "status NOT IN ('F')"),
    (R("status", "not_in", ["F"]), "status IN ('F')"),
    (R("level", "is_in", [1, 2, 3]), "level NOT IN ('1', '2', '3')"),
]
row_rules("row_membership", "orders", MEMBERSHIP, TEXTS)
row_rules("row_nulls_fail", "orders", [*MEMBERSHIP, (R("status", "is_equal", "F"), "status <> 'F'"), (R("status", "has_pattern", "^F"), "NOT regexp_matches(status, '^F')")], TEXTS, null_fails=True)

PATTERNS = [
    (R("o_orderpriority", "has_pattern", "^[1-3]-", 0.5), "NOT regexp_matches(o_orderpriority, '^[1-3]-')"),
    (R("status", "has_pattern", "[FO]"), "NOT regexp_matches(status, '[FO]')"),
    (R("note", "is_legit", threshold=0.4), r"note IS NULL OR NOT regexp_matches(note, '\S')"),
    (R("status", "is_legit"), r"status IS NULL OR NOT regexp_matches(status, '\S')"),
]
row_rules("row_patterns", "orders", PATTERNS, TEXTS)

_D = "CAST(o_orderdate AS DATE)"
DATE_RULES = [
    (R("o_orderdate", "is_today"), f"{_D} <> DATE '{AS_OF}'"),
    *((R("o_orderdate", c), f"{_D} <> DATE '{AS_OF}' - {n}") for c, n in (("is_t_minus_1", 1), ("is_yesterday", 1), ("is_t_minus_2", 2), ("is_t_minus_3", 3))),
    (R("o_orderdate", "is_past_date", threshold=0.5), f"{_D} >= DATE '{AS_OF}'"),
    (R("o_orderdate", "is_future_date"), f"{_D} <= DATE '{AS_OF}'"),
    (R("o_orderdate", "is_date_between", ["1993-01-01", "1997-12-31"]), f"NOT {_D} BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'"),
    (R("o_orderdate", "is_date_after", "1993-01-01"), f"{_D} <= DATE '1993-01-01'"),
    (R("o_orderdate", "is_date_before", "1997-01-01"), f"{_D} >= DATE '1997-01-01'"),
    (R("o_orderdate", "is_on_weekday", threshold=0.7), f"isodow({_D}) > 5"),
    (R("o_orderdate", "is_on_weekend"), f"isodow({_D}) <= 5"),
    *((R("o_orderdate", f"is_on_{d}"), f"isodow({_D}) <> {i}") for i, d in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"), 1)),
]
row_rules("row_dates", "orders", DATE_RULES, as_of=AS_OF)
FORMATS = [
    (R("day", "validate_date_format", "%Y-%m-%d", 0.8), "day IS NOT NULL AND try_strptime(day, '%Y-%m-%d') IS NULL"),
    (R("slashed", "validate_date_format", "%d/%m/%Y"), "slashed IS NOT NULL AND try_strptime(slashed, '%d/%m/%Y') IS NULL"),
    (R("day", "validate_date_format"), "day IS NOT NULL AND TRY_CAST(day AS DATE) IS NULL"),
    (R("day", "all_date_checks"), f"day IS NOT NULL AND (TRY_CAST(day AS DATE) IS NULL OR TRY_CAST(day AS DATE) > DATE '{AS_OF}' OR TRY_CAST(day AS DATE) < DATE '1900-01-01')"),
    (R("day", "is_past_date"), f"TRY_CAST(day AS DATE) >= DATE '{AS_OF}'"),
    (R("day", "is_on_monday"), "isodow(TRY_CAST(day AS DATE)) <> 1"),
]
row_rules("row_date_texts", "orders", FORMATS, DATES, as_of=AS_OF)

SQL_RULES = [
    (R("*", "satisfies", "value >= 10 AND event_type <> 'error'", 0.5), "NOT (value >= 10 AND event_type <> 'error')"),
    (R("value", "satisfies", "user_id % 2 = 0 OR value > 50"), "NOT (user_id % 2 = 0 OR value > 50)"),
]
row_rules("row_satisfies", "events", SQL_RULES)
row_rules("filter_per_rule", "events", [(R("value", "is_greater_than", 20, filter="event_type = 'click'"), "value <= 20"), (R("value", "is_complete"), "value IS NULL")])
row_rules("filter_global", "events", [(R("value", "is_between", [10, 90]), "NOT value BETWEEN 10 AND 90"), *SQL_RULES], where="user_id % 3 = 1")
row_rules("report_empty_table", "events", [(R("value", "is_positive"), "value <= 0"), (R("value", "is_complete"), "value IS NULL")], where="event_id < 0")


def _unique(keys: str, check: str, table: str) -> str:
    return f"""SELECT '{check}' AS check_type, '{keys}' AS field, coalesce((SELECT sum(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys}) WHERE n > 1), 0)::BIGINT AS fail_count,
               (SELECT count(*) FROM {table}) AS total_rows"""


UNIQUENESS = [("text", "is_unique"), ("doc_id", "is_primary_key"), ("lang,source", "are_unique"), ("doc_id,lang", "is_composite_key")]


@query("row_uniqueness", f"""
    WITH r AS ({" UNION ALL ".join(_unique(k, c, "documents") for k, c in UNIQUENESS)})
    SELECT check_type, field, CASE WHEN fail_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status, fail_count, total_rows, round((total_rows - fail_count) / CAST(total_rows AS DOUBLE), 6) AS pass_rate FROM r""")
def row_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read(spark, sf_dir, "documents"), [R(k, c) for k, c in UNIQUENESS])


@query("row_composite_key", f"""
    WITH r AS ({_unique("l_orderkey,l_linenumber", "is_composite_key", "lineitem")})
    SELECT check_type, field, 'FAIL' AS status, fail_count, total_rows, round((total_rows - fail_count) / CAST(total_rows AS DOUBLE), 6) AS pass_rate FROM r""")
def row_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read(spark, sf_dir, "lineitem"), [R("l_orderkey,l_linenumber", "is_composite_key")])


AGGREGATES = [
    ("l_quantity", "has_min", "min(l_quantity)", 1, 0.0), ("l_quantity", "has_max", "max(l_quantity)", 45, 0.2), ("l_quantity", "has_sum", "sum(l_quantity)", 1, 0.1),
    ("l_quantity", "has_mean", "avg(l_quantity)", 25, 0.1), ("l_quantity", "has_std", "stddev_samp(l_quantity)", 14, 0.1), ("l_returnflag", "has_cardinality", "count(DISTINCT l_returnflag)", 3, 0.0),
    ("l_suppkey", "has_cardinality", "count(DISTINCT l_suppkey)", 7, 0.1),
]


@query("table_aggregates", "WITH r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS check_type, '{f}' AS field, CAST({sql} AS DOUBLE) AS a, {e} AS e, {t} AS tol FROM lineitem" for f, c, sql, e, t in AGGREGATES) + """)
    SELECT check_type, field, CASE WHEN abs(a - e) <= tol * abs(e) THEN 'PASS' ELSE 'FAIL' END AS status, round(a, 4) AS actual FROM r""")
def table_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = validate(read(spark, sf_dir, "lineitem"), [R(f, c, e, t) for f, c, _, e, t in AGGREGATES]).to_df()
    return report.select("check_type", "field", "status", F.round(F.col("actual").cast("double"), 4).alias("actual"))


_H = "(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM lineitem GROUP BY {}))"


@query("table_entropy", f"""
    SELECT 'has_entropy' AS check_type, 'l_returnflag' AS field, 'PASS' AS status, round({_H.format('l_returnflag')}, 6) AS actual
    UNION ALL SELECT 'has_infogain', 'l_linestatus,l_returnflag', CASE WHEN abs({_H.format('l_returnflag')} + {_H.format('l_linestatus')} - {_H.format('l_linestatus, l_returnflag')} - 0.5) <= 0.1 * 0.5 THEN 'PASS' ELSE 'FAIL' END,
        round({_H.format('l_returnflag')} + {_H.format('l_linestatus')} - {_H.format('l_linestatus, l_returnflag')}, 6)""")
def table_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [R("l_returnflag", "has_entropy", 1.5, 0.2), R("l_linestatus,l_returnflag", "has_infogain", 0.5, 0.1)]
    report = validate(read(spark, sf_dir, "lineitem"), rules).to_df()
    return report.select("check_type", "field", "status", F.round(F.col("actual").cast("double"), 6).alias("actual"))


CONTRACT = {
    "strict": True,
    "columns": [{"name": "vec_id", "type": "bigint"}, {"name": "embedding", "type": "array", "element_type": "string"}, {"name": "missing", "type": "string"}, {"name": "maybe", "type": "date", "optional": True}],
}


@query("table_schema", "SELECT 'validate_schema' AS check_type, 'FAIL' AS status, 3 AS issues UNION ALL SELECT 'contract', 'embedding: Expected elements string, got float; label: not in the contract; missing: missing', 3")
def table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings")
    report = validate(df, [R("*", "validate_schema", CONTRACT)]).to_df().select("check_type", "status", F.col("fail_count").cast("int").alias("issues"))
    found = validate_schema(df, SchemaDef.from_dict(CONTRACT))
    return report.unionByName(spark.createDataFrame([("contract", "; ".join(sorted(found.issues())), found.total_issues)], "check_type string, status string, issues int"))


@query("schema_extract", """
    SELECT * FROM (VALUES ('vec_id', 'integer', '', 'bigint'), ('embedding', 'array', 'float', 'array<float>'), ('label', 'integer', '', 'int')) AS v(name, type, element_type, raw_type)""")
def schema_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = extract_schema(read(spark, sf_dir, "embeddings"))["columns"]
    return spark.createDataFrame([(c["name"], c["type"], c.get("element_type", ""), c["raw_type"]) for c in columns], "name string, type string, element_type string, raw_type string")


SPLIT_RULES = [
    R("o_orderstatus", "is_in", ["F", "O"]), R("o_totalprice", "is_between", [1000, 400000]), R("o_orderkey", "is_unique"), R("o_custkey", "is_less_than", 10**9), R("o_orderdate", "is_on_weekday", threshold=0.5),
]
_BROKEN = "(o_orderstatus NOT IN ('F', 'O') OR NOT o_totalprice BETWEEN 1000 AND 400000 OR o_orderkey IN (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))"


@query("split_good", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT {_BROKEN}")
def split_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(read(spark, sf_dir, "orders"), SPLIT_RULES).split()[0].select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("split_bad", f"""
    SELECT o_orderkey, CAST((o_orderstatus NOT IN ('F', 'O'))::INT + (NOT o_totalprice BETWEEN 1000 AND 400000)::INT + (o_orderkey IN (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))::INT AS INT) AS errors
    FROM orders WHERE {_BROKEN}""")
def split_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(read(spark, sf_dir, "orders"), SPLIT_RULES).split()[1].select("o_orderkey", F.size("_dq_errors").alias("errors"))


_DUPLICATE = "(SELECT text FROM documents GROUP BY text HAVING count(*) > 1)"


#: Rules that can't be applied, for their names, syntax, types or pattern, or that fail on the data.
FAULTY = [
    R("*", "satisfies", "nope > 1"), R("*", "satisfies", "o_custkey >"), R("*", "satisfies", "o_custkey"), R("*", "satisfies", "CAST(o_orderpriority AS INT) > 1"), R("o_orderpriority", "has_pattern", "("),
    R("parts", "is_equal", 1), R("parts", "has_mean", 1, 0.1), R("o_custkey", "is_positive", filter="nope = 1"), R("parts", "is_equal_than", "o_custkey"),
]


@query("rule_errors", f"""
    WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS f, count(*) - count(o_custkey) AS g, max(o_totalprice) AS m FROM orders),
         r AS (SELECT 'is_in' AS check_type, 'o_orderstatus' AS field, f AS fail_count, n FROM t UNION ALL SELECT 'is_complete', 'o_custkey', g, n FROM t)
    SELECT check_type, field, CASE WHEN fail_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status, fail_count, n AS total_rows, round((n - fail_count) / CAST(n AS DOUBLE), 6) AS pass_rate FROM r
    UNION ALL SELECT 'has_max', 'o_totalprice', 'PASS', -1, n, 1.0 FROM t WHERE m > 0
    {"".join(f" UNION ALL SELECT '{r.check_type}', '{r.label}', 'ERROR', -1, n, -1.0 FROM t" for r in FAULTY)}""")
def rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine faulty rules among three good ones: each is an error by itself, and the others have their verdicts."""
    df = read(spark, sf_dir, "orders").withColumn("parts", F.split("o_orderpriority", "-"))
    good = [R("o_orderstatus", "is_in", ["F", "O"]), R("o_custkey", "is_complete"), R("o_totalprice", "has_max", 1, 1e12)]
    return verdicts(df, [*FAULTY[:5], *good, *FAULTY[5:]]).fillna({"fail_count": -1, "pass_rate": -1.0})


@query("dq_errors", f"""
    SELECT doc_id, 'is_unique' AS check_type, 'text' AS field, 'uniqueness' AS category FROM documents WHERE text IN {_DUPLICATE}
    UNION ALL SELECT doc_id, 'is_in', 'lang', 'membership' FROM documents WHERE lang NOT IN ('en', 'fr')
    UNION ALL SELECT doc_id, 'is_less_than', 'n_chars', 'comparison' FROM documents WHERE n_chars >= 5000""")
def dq_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [R("text", "is_unique"), R("lang", "is_in", ["en", "fr"]), R("n_chars", "is_less_than", 5000), R("source", "is_complete")]
    rows = validate(read(spark, sf_dir, "documents"), rules).df.select("doc_id", F.explode("_dq_errors").alias("e"))
    return rows.select("doc_id", "e.check_type", "e.field", "e.category")


EMITTED = [
    *(r for r, _ in DATE_RULES), R("o_orderkey", "is_unique"), R("o_orderstatus,o_orderpriority", "are_complete"), R("o_orderstatus", "is_in", ["F"]), R("o_orderpriority", "has_pattern", "^[12]-"),
    R("o_totalprice", "has_mean", 1), R("o_custkey", "has_cardinality", 1), R("o_totalprice", "is_between", [1000.0, 200000.0]), R("o_orderpriority", "is_legit"), R("o_orderpriority", "all_date_checks"),
    R("*", "satisfies", "o_totalprice > 500", filter="o_custkey > 100"),
]


def _emitted(dialect: str) -> str:
    sql, ids = compile_rules_to_sql(EMITTED, "orders", dialect, where="o_totalprice > 5000", as_of=AS_OF)
    return "SELECT " + ", ".join(f"round(CAST(rule_{i} AS DOUBLE), 5) AS rule_{i}" for i in range(len(ids))) + f" FROM ({sql}) q"


@query("sql_emission", _emitted("duckdb"))
def sql_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' SELECT in Spark's dialect; the oracle is the same rules' SELECT in DuckDB's."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_emitted("spark"))


def _profiled(table: str, columns: Sequence[tuple[str, str, bool]]) -> str:
    rows = []
    for name, kind, number in columns:
        c = f'"{name}"'
        figures = ", ".join(f"CAST(round({f}({c}), 4) AS DOUBLE) AS {n}" if number else f"CAST(NULL AS DOUBLE) AS {n}" for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_samp", "std_dev"), ("sum", "sum")))
        rows.append(f"SELECT '{name}' AS \"column\", '{kind}' AS type, count(*) AS row_count, count({c}) / CAST(count(*) AS DOUBLE) AS completeness, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 4) AS uniqueness, {figures} FROM {table}")
    return " UNION ALL ".join(rows)


EVENT_COLUMNS = [("event_id", "integer", True), ("ts", "datetime", False), ("user_id", "integer", True), ("event_type", "string", False), ("value", "float", True), ("props", "string", False)]


@query("profile", _profiled("events", EVENT_COLUMNS))
def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile_df(read(spark, sf_dir, "events"), approx=False).drop("nullable")
    return out.withColumns({c: F.round(c, 4) for c in ("min", "max", "mean", "std_dev", "sum")})


@query("rules_table", ORACLES["row_satisfies"])
def rules_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that come from a table, with all values as text."""
    table = spark.createDataFrame([(r.label, r.check_type, str(r.value), str(r.threshold), "ops") for r, _ in SQL_RULES], "field string, check_type string, value string, threshold string, owner string")
    return verdicts(read(spark, sf_dir, "events"), load_rules(table))


@query("rules_csv", ORACLES["row_comparison"])
def rules_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules written to a CSV file on the driver and read again."""
    with tempfile.TemporaryDirectory() as folder:
        save_rules_csv([r for r, _ in COMPARISON], Path(folder, "rules.csv"))
        rules = load_rules_csv(Path(folder, "rules.csv"))
    return verdicts(read(spark, sf_dir, "lineitem"), rules)


STREAM_RULES = [R("value", "is_between", [10, 90]), R("event_type", "not_in", ["error"]), R("ts", "is_on_weekday"), R("event_id", "is_unique"), R("value", "has_mean", 50)]
_STREAM_BAD = "(NOT value BETWEEN 10 AND 90 OR event_type IN ('error') OR isodow(CAST(ts AS DATE)) > 5)"


@query("stream_split", f"SELECT event_id, {_STREAM_BAD} AS bad, CAST((NOT value BETWEEN 10 AND 90)::INT + (event_type IN ('error'))::INT + (isodow(CAST(ts AS DATE)) > 5)::INT AS INT) AS errors FROM events")
def stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over all events, written to two sinks in one query; uniqueness and aggregate rules are refused with an error."""
    source = f"{sf_dir}/events.parquet"
    # A pattern, as the source may be one file, and a stream's path has to be a folder or a pattern.
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{sf_dir}/events.parque[t]")
    folder = scratch_path(spark, "stream-split")
    checked = validate_stream(stream, STREAM_RULES)
    checked.write(f"{folder}/good", f"{folder}/bad", f"{folder}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{folder}/good").select("event_id", F.lit(False).alias("bad"), F.lit(0).alias("errors"))
    return good.unionByName(spark.read.parquet(f"{folder}/bad").select("event_id", F.lit(True).alias("bad"), F.size("_dq_errors").alias("errors")))


@query("windowed_metrics", """
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS total_rows, count(*) FILTER (WHERE NOT value BETWEEN 10 AND 90) AS out_of_range, count(*) FILTER (WHERE event_type IN ('error')) AS errors
    FROM events GROUP BY 1""")
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed_metrics(read(spark, sf_dir, "events"), STREAM_RULES[:2], "ts", "1 day", "1 hour")
    return out.select(F.col("window_start").alias("day"), "total_rows", F.col("fails")["0:is_between:value"].alias("out_of_range"), F.col("fails")["1:not_in:event_type"].alias("errors"))


@query("summary", """
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS f FROM orders)
    SELECT n AS total_rows, 2 AS validations, (CASE WHEN f = 0 THEN 1 ELSE 0 END) + 1 AS passed, CASE WHEN f = 0 THEN 0 ELSE 1 END AS failed, f AS fail_count FROM c""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = json.loads(json.dumps(validate(read(spark, sf_dir, "orders"), [R("o_orderstatus", "is_in", ["F", "O"]), R("o_custkey", "is_complete")]).summary(key_columns=["o_orderkey"]), default=str))
    row = (s["total_rows"], s["total_validations"], s["passed"], s["failed"], s["validations"][0]["fail_count"])
    return spark.createDataFrame([row], "total_rows bigint, validations int, passed int, failed int, fail_count bigint")


def replayed(spark: SparkSession, sf_dir: str, start: Callable[[DataFrame, str], StreamingQuery], slices: int = 3) -> str:
    """Put events into a folder in slices by their id, and run a stream over the folder after each; the stream's folder of its own."""
    events, folder = read(spark, sf_dir, "events"), scratch_path(spark, "replay")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    cuts = [low + (high - low + 1) * i // slices for i in range(slices + 1)]
    for a, b in zip(cuts, cuts[1:]):
        events.where((F.col("event_id") >= a) & (F.col("event_id") < b)).write.mode("append").parquet(f"{folder}/source")
        start(spark.readStream.schema(events.schema).parquet(f"{folder}/source"), folder).awaitTermination()
    return folder


THROWING = R("*", "satisfies", "CAST(CASE WHEN value > 40 THEN event_type ELSE '7' END AS INT) > 5")


@query("stream_rule_errors", f"SELECT *, 1 AS rule_errors FROM ({ORACLES['stream_split'].replace(' OR isodow(CAST(ts AS DATE)) > 5', '').replace(' + (isodow(CAST(ts AS DATE)) > 5)::INT', '')}) q")
def stream_rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that throws on some rows, beside two good ones, in several batches: it is switched off with an error, all rows reach a sink."""
    runs = []

    def start(stream: DataFrame, folder: str) -> StreamingQuery:
        runs.append(validate_stream(stream, [STREAM_RULES[0], THROWING, STREAM_RULES[1]]))
        return runs[-1].write(f"{folder}/good", f"{folder}/bad", f"{folder}/checkpoint")

    folder = replayed(spark, sf_dir, start)
    good = read_committed(spark, f"{folder}/good", f"{folder}/checkpoint").select("event_id", F.lit(False).alias("bad"), F.lit(0).alias("errors"))
    bad = read_committed(spark, f"{folder}/bad", f"{folder}/checkpoint").select("event_id", F.lit(True).alias("bad"), F.size("_dq_errors").alias("errors"))
    return good.unionByName(bad).withColumn("rule_errors", F.lit(len(runs[-1].errors)))


STATE_RULES = [
    R("value", "has_mean", 50, 0.1), R("value", "has_std", 29, 0.1), R("value", "has_min", 0, 0), R("value", "has_max", 100, 0.1), R("user_id", "has_cardinality", 100, 0.5), R("event_id", "has_sum", 1, 0),
    R("event_type", "has_entropy", 2, 0.5), R("event_type,user_id", "has_infogain", 0.5, 0.1),
]
_E = "(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM events GROUP BY {}))"
_STATE_SQL = ["avg(value)", "stddev_samp(value)", "min(value)", "max(value)", "count(DISTINCT user_id)", "sum(event_id)", _E.format("event_type"), f"{_E.format('event_type')} + {_E.format('user_id')} - {_E.format('event_type, user_id')}"]
_STATE_ORACLE = "WITH r AS (" + " UNION ALL ".join(f"SELECT '{r.check_type}' AS check_type, '{r.label}' AS field, (SELECT CAST({sql} AS DOUBLE) FROM events) AS a, {r.value} AS e, {r.threshold} AS tol" if "events GROUP" not in sql else f"SELECT '{r.check_type}', '{r.label}', {sql}, {r.value}, {r.threshold}" for r, sql in zip(STATE_RULES, _STATE_SQL)) + """)
    SELECT check_type, field, CASE WHEN abs(a - e) <= tol * abs(e) THEN 'PASS' ELSE 'FAIL' END AS status, round(a, 6) AS actual FROM r"""


@query("metric_states", _STATE_ORACLE)
def metric_states_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of table rules by day, stored, read again, merged: the verdicts of one pass over all days."""
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    states, folder = metric_states(bind(events, STATE_RULES), by=["day"]), scratch_path(spark, "states")
    states.write(folder)
    report = states.read(folder).report().to_df()
    return report.select("check_type", "field", "status", F.round(F.col("actual").cast("double"), 6).alias("actual"))


TOTAL_RULES = [*STATE_RULES[:5], R("value", "is_between", [10, 90]), R("event_type", "not_in", ["error"], 0.5), R("user_id,event_type", "are_unique")]


@query("stream_totals", f"""
    SELECT check_type, field, status, actual, -1 AS fail_count FROM ({_STATE_ORACLE}) q WHERE check_type NOT IN ('has_sum', 'has_entropy', 'has_infogain')
    UNION ALL SELECT check_type, field, CASE WHEN (n - f) / CAST(n AS DOUBLE) >= t THEN 'PASS' ELSE 'FAIL' END, round((n - f) / CAST(n AS DOUBLE), 6), f FROM (
        SELECT 'is_between' AS check_type, 'value' AS field, 1.0 AS t, count(*) AS n, count(*) FILTER (WHERE NOT value BETWEEN 10 AND 90) AS f FROM events
        UNION ALL SELECT 'not_in', 'event_type', 0.5, count(*), count(*) FILTER (WHERE event_type IN ('error')) FROM events
        UNION ALL SELECT 'are_unique', 'user_id,event_type', 1.0, CAST(sum(n) AS BIGINT), CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)) q""")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table and uniqueness rules on a stream of several batches, answered in total from the states of its batches."""
    runs = []

    def start(stream: DataFrame, folder: str) -> StreamingQuery:
        runs.append(validate_stream(stream, TOTAL_RULES, totals=True))
        return runs[-1].write(f"{folder}/good", f"{folder}/bad", f"{folder}/checkpoint")

    folder = replayed(spark, sf_dir, start)
    report = runs[-1].report(spark, f"{folder}/checkpoint").to_df()
    return report.select("check_type", "field", "status", F.round(F.col("actual").cast("double"), 6).alias("actual"), F.coalesce("fail_count", F.lit(-1)).cast("bigint").alias("fail_count"))


def weighted_mean(context, rule: R, rows) -> Column:
    """A table rule of a user's own: the mean of the first field, weighted by the second."""
    value, weight = (F.col(f) for f in rule.fields)
    return F.sum(F.when(rows, value * weight)) / F.sum(F.when(rows, weight))


@query("custom_table_rule", """
    WITH r AS (SELECT 'has_weighted_mean' AS check_type, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS a FROM lineitem
               UNION ALL SELECT 'has_weighted_mean', sum(l_extendedprice * l_quantity) / sum(l_quantity) FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'has_mean', avg(l_quantity) FROM lineitem)
    SELECT check_type, round(a, 3) AS actual, CASE WHEN check_type = 'has_mean' OR a > 1000 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def custom_table_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rules of a user's own, with a verdict of their own, in the pass of the others."""
    register_table_rule("has_weighted_mean", weighted_mean, lambda actual, rule: actual is not None and actual > rule.value)
    fields = "l_extendedprice,l_quantity"
    rules = [R(fields, "has_weighted_mean", 1000), R(fields, "has_weighted_mean", 1000, filter="l_returnflag = 'A'"), R("l_quantity", "has_mean", 25, 0.5)]
    try:
        report = validate(read(spark, sf_dir, "lineitem"), rules).to_df()
    finally:
        unregister_rule("has_weighted_mean")
    return report.select("check_type", F.round(F.col("actual").cast("double"), 3).alias("actual"), "status")


@query("stream_unique", "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS seen_before FROM events")
def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in several batches; each row is told whether its user has had an event of that type before."""

    def start(stream: DataFrame, folder: str) -> StreamingQuery:
        flagged = flag_seen(stream.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"])
        with keyed_state(spark):
            return flagged.writeStream.format("parquet").option("path", f"{folder}/flagged").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

    return spark.read.parquet(f"{replayed(spark, sf_dir, start)}/flagged")


OBSERVED_RULES = [*SPLIT_RULES[:4], R("o_orderdate", "is_on_weekday", threshold=0.99), R("o_orderpriority", "not_in", ["1-URGENT"], 0.1), R("o_totalprice", "has_mean", 1, 0.1)]
_OBSERVED_BAD = {"is_in": "o_orderstatus NOT IN ('F', 'O')", "is_between": "NOT o_totalprice BETWEEN 1000 AND 400000", "is_unique": "o_orderkey IN (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)", "is_on_weekday": "isodow(CAST(o_orderdate AS DATE)) > 5"}


@query("observed_split", f"""
    WITH t AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _OBSERVED_BAD.items())} FROM orders)
    SELECT o_orderkey, CAST({" + ".join(f"({c})::INT" for c in _OBSERVED_BAD.values())} AS INT) AS errors, {" || ',' || ".join(f"t.{k}" for k in _OBSERVED_BAD)} AS fails FROM orders, t""")
def observed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and both parts from the job that writes the rows; a rule that passes by its threshold marks no row."""
    out = validate_and_write(read(spark, sf_dir, "orders"), OBSERVED_RULES, scratch_path(spark, "observed"))
    fails = {r.check_type: r.fail_count for r in out.report}
    rows = out.good.select("o_orderkey", F.lit(0).alias("errors")).unionByName(out.bad.select("o_orderkey", F.size("_dq_errors").alias("errors")))
    return rows.withColumn("fails", F.lit(",".join(str(fails[k]) for k in _OBSERVED_BAD)))


PUSHED_RULES = [
    R("value", "is_between", [10, 90]), R("event_type", "not_in", ["error"], 0.5), R("value", "is_complete"), R("ts", "is_past_date"), R("ts", "is_on_weekday", threshold=0.5), R("event_type", "has_pattern", "^c"), R("nope", "is_positive"),
    R("user_id", "has_mean", 50, 0.9), R("value", "has_std", 29, 0.1), R("value", "has_max", 1, 0), R("user_id", "has_cardinality", 15, 0), R("value", "is_greater_than", 20, filter='"event_type" = \'click\''),
]
_PUSHED_ROWS = ["NOT value BETWEEN 10 AND 90", "event_type IN ('error')", "value IS NULL", f"CAST(ts AS DATE) >= DATE '{AS_OF}'", "isodow(CAST(ts AS DATE)) > 5"]
_PUSHED_FIGURES = ["avg(user_id)", "stddev_samp(value)", "max(value)", "count(DISTINCT user_id)"]


@query("jdbc_pushdown", f"""
    WITH r AS ({" UNION ALL ".join(f"SELECT '{r.check_type}' AS check_type, '{r.label}' AS field, {r.threshold} AS t, count(*) AS n, count(*) FILTER (WHERE {c}) AS f FROM events" for r, c in zip(PUSHED_RULES, _PUSHED_ROWS))}
               UNION ALL SELECT 'is_greater_than', 'value', 1.0, count(*), count(*) FILTER (WHERE value <= 20) FROM events WHERE event_type = 'click')
    SELECT check_type, field, CASE WHEN (n - f) / CAST(n AS DOUBLE) >= t THEN 'PASS' ELSE 'FAIL' END AS status, round((n - f) / CAST(n AS DOUBLE), 6) AS actual, f AS fail_count FROM r
    UNION ALL SELECT * FROM (VALUES ('has_pattern', 'event_type', 'ERROR', -1.0, -1), ('is_positive', 'nope', 'ERROR', -1.0, -1))
    {"".join(f" UNION ALL SELECT '{r.check_type}', '{r.label}', CASE WHEN abs({s} - {r.value}) <= {r.threshold} * {r.value} THEN 'PASS' ELSE 'FAIL' END, round(CAST({s} AS DOUBLE), 6), -1 FROM events" for r, s in zip(PUSHED_RULES[7:11], _PUSHED_FIGURES))}""")
def jdbc_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a database, where the rules' SELECT runs: Derby, embedded in the driver's JVM and kept on its disk.

    Executors can't reach it. They write the events as CSV to the shared folder, which the database imports by itself.
    """
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    events, path = read(spark, sf_dir, "events").drop("props"), scratch_path(spark, "events")
    events.write.options(quote='"', escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    kinds = {"string": "VARCHAR(64)", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}
    manager = spark._jvm.java.sql.DriverManager
    with tempfile.TemporaryDirectory(prefix="tamis-derby-") as folder:
        url = f"jdbc:derby:{os.path.realpath(folder)}/db"
        connection = manager.getConnection(f"{url};create=true")
        try:
            statement = connection.createStatement()
            statement.execute("CREATE TABLE EVENTS (" + ", ".join(f'"{c}" {kinds.get(k, k.upper())}' for c, k in events.dtypes) + ")")
            for part in spark.read.text(path).inputFiles():
                statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'EVENTS', '{part}', NULL, NULL, 'UTF-8', 0)")
            report = validate_pushed(connection_runner(connection), "EVENTS", PUSHED_RULES, "derby", as_of=AS_OF).to_df(spark)
        finally:
            connection.close()
            with contextlib.suppress(Exception):  # so Derby says that it is shut down
                manager.getConnection(f"{url};shutdown=true")
    return report.select("check_type", "field", "status", F.round(F.coalesce(F.col("actual").cast("double"), F.lit(-1.0)), 6).alias("actual"), F.coalesce("fail_count", F.lit(-1)).cast("bigint").alias("fail_count"))


@query("session_metrics", """
    WITH t AS (SELECT *, ts >= lag(ts) OVER w + INTERVAL 30 MINUTE AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         s AS (SELECT *, count(*) FILTER (WHERE far) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM t)
    SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 1800000000 AS ended, count(*) AS total_rows, count(*) FILTER (WHERE NOT value BETWEEN 10 AND 90) AS out_of_range FROM s GROUP BY user_id, session""")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and failures by session of a user: events of which none comes half an hour after the one before."""
    out = windowed_metrics(read(spark, sf_dir, "events"), STREAM_RULES[:1], "ts", None, "1 hour", session_gap="30 minutes", by=["user_id"])
    at = [F.unix_micros(F.col(c).cast("timestamp")).alias(n) for c, n in (("window_start", "started"), ("window_end", "ended"))]
    return out.select("user_id", *at, "total_rows", F.col("fails")["0:is_between:value"].alias("out_of_range"))


@query("sliding_metrics", """
    SELECT epoch_us(day) AS started, count(*) AS total_rows, count(*) FILTER (WHERE NOT value BETWEEN 10 AND 90) AS out_of_range
    FROM (SELECT value, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS day FROM events) q GROUP BY day""")
def sliding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days that begin every day."""
    out = windowed_metrics(read(spark, sf_dir, "events"), STREAM_RULES[:1], "ts", "2 days", "1 hour", slide="1 day")
    return out.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("started"), "total_rows", F.col("fails")["0:is_between:value"].alias("out_of_range"))


@query("sql_transpiled", _emitted("duckdb"))
def sql_transpiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' SELECT for Spark, printed anew in Spark's dialect from the tree of its parser: the same row."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(from_spark(spark, _emitted("spark"), "spark"))
