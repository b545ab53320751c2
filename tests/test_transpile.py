"""SELECTs of Spark printed for other dialects; DuckDB's run there and give the same row."""

import duckdb
import pytest

from tamis import RuleDefinition as R
from tamis import compile_rules_to_sql, transpile
from tamis.functions.predicates import java_pattern
from tamis.plans.sqlgen import DIALECTS
from tamis.plans.transpile import from_spark, strftime_pattern
from tamis.queries import COMPARISON, DATE_RULES, EMITTED, FORMATS, MEMBERSHIP, PATTERNS, SQL_RULES

DAY = "1996-06-15"


def both(spark, sql, views):
    """The row in Spark, and that of the printed SQL in DuckDB."""
    con = duckdb.connect()
    for name, df in views.items():
        df.createOrReplaceTempView(name)
        con.register(name, df.toPandas())
    ours, theirs = spark.sql(sql).collect(), con.sql(from_spark(spark, sql, "duckdb")).fetchall()
    return [tuple(None if v is None else round(float(v), 4) if isinstance(v, (int, float)) or "Decimal" in type(v).__name__ else str(v) for v in r) for rows in ([ours, theirs]) for r in rows]


@pytest.mark.parametrize(("table", "rules"), [("orders", [*(r for r, _ in DATE_RULES), *EMITTED]), ("lineitem", [r for r, _ in COMPARISON]), ("texts", [r for r, _ in [*MEMBERSHIP, *PATTERNS]]), ("dates", [r for r, _ in FORMATS]), ("events", [r for r, _ in SQL_RULES])])
def test_rules_selects(spark, sf, table, rules):
    from tamis import queries

    df = {"texts": queries.texts_with_gaps, "dates": queries.date_texts}.get(table, lambda s, d: queries.read(s, d, table))(spark, sf)
    for policy in ("skip", "fail"):
        rows = both(spark, compile_rules_to_sql(rules, table, "spark", as_of=DAY, null_policy=policy, counts=True)[0], {table: df})
        assert len(rows) == 2 and rows[0] == rows[1]


def test_other_clauses(spark):
    t = spark.createDataFrame([(1, "a", 2.5), (2, "b'c", -1.0), (3, None, 0.0), (2, "a", 7.25)], "k int, `s t` string, x double")
    u = spark.createDataFrame([(1, True), (2, False)], "k int, b boolean")
    sql = """SELECT DISTINCT t.k AS key, sum(x) FILTER (WHERE `s t` <> 'q''r') AS total, count(*) AS n, max(`s t` || '!') m, min(CASE WHEN x > 0 THEN -x ELSE NULL END) AS low
             FROM t LEFT JOIN u AS v ON t.k = v.k WHERE NOT (x = 0.5D) AND (`s t` LIKE 'a%' OR b IS NOT NULL OR x % 2 = 0) GROUP BY t.k HAVING count(1) >= 1 ORDER BY key DESC LIMIT 2"""
    rows = both(spark, sql, {"t": t, "u": u})
    assert len(rows) == 4 and rows[:2] == rows[2:]
    inner = both(spark, "SELECT a.* FROM (SELECT k, DATE '2024-02-29' AS d, CAST(x AS DECIMAL(9,2)) AS x, TRY_CAST(`s t` AS INT) AS i FROM t) a ORDER BY k, x", {"t": t})
    assert inner[:4] == inner[4:]
    assert from_spark(spark, "SELECT 1 AS one", "duckdb") == 'SELECT\n  1 AS "one"'


def test_every_dialect(spark):
    sql = compile_rules_to_sql([R("d", "is_on_monday"), R("d", "is_yesterday"), R("a,b", "are_complete"), R("a", "has_std", 1), R("a", "is_in", [1, 2])], "db.t", "spark")[0]
    for dialect in DIALECTS:
        assert "FROM" in transpile(sql, "spark", dialect, spark)
    assert "SAFE_CAST" in transpile(sql, "spark", "bigquery") and "pg_input_is_valid" in transpile(sql, "spark", "postgres") and "`db`.`t`" in transpile(sql, "databricks", "doris")
    for other in ("SELECT explode(a) OVER (PARTITION BY b) FROM t", "SELECT a FROM t UNION SELECT b FROM u", "SELECT a[0] FROM t"):
        with pytest.raises(NotImplementedError):
            transpile(other, "spark", "duckdb")
    with pytest.raises(NotImplementedError, match="sqlglot"):
        transpile("select 1", "mysql", "duckdb")
    with pytest.raises(ValueError):
        from_spark(spark, "select 1", "cobol")


@pytest.mark.parametrize("form", ["%Y-%m-%d", "%d de %B, %H:%M", "%I:%M:%S.%f %p", "100%% o'clock %H"])
def test_patterns(form):
    assert strftime_pattern(java_pattern(form)) == form
