"""Rules judged by a database's own row: Derby in this JVM, engines that take jobs, faults; and windows of streams."""

import uuid
from datetime import datetime, timedelta

import pytest

from tamis import RuleDefinition as R
from tamis import validate, windowed_metrics
from tamis.operators.pushdown import jdbc_runner, polled_runner, validate_pushed
from tamis.sources.warehouses import KINDS, warehouse
from tamis.streaming.seen import count_late, keyed_state


@pytest.fixture(scope="module")
def derby(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = [(i, None if i % 7 == 0 else i % 5, f"s{i % 3}", datetime(2024, 1, 1) + timedelta(days=i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, n int, s string, day timestamp")
    df.write.format("jdbc").options(url=url, dbtable="T", createTableColumnTypes="s VARCHAR(9)").save()
    return jdbc_runner(spark, url), df


RULES = [
    R("n", "is_complete"), R("n", "is_between", [1, 3]), R("s", "is_in", ["s0", "s1"], 0.5), R("n,s", "are_complete"), R("n", "is_equal_than", "id"), R("day", "is_date_after", "2024-02-01"), R("day", "is_on_monday"), R("day", "is_on_weekend", threshold=0.2),
    R("day", "is_t_minus_2"), R("day", "is_today"), R("n", "has_mean", 2, 0.1), R("n", "has_std", 1.4, 0.1), R("id", "has_sum", 4950, 0), R("n", "has_cardinality", 5, 0), R("id", "has_max", 99, 0), R("id", "is_positive", filter='"s" = \'s1\''), R("n", "is_complete", execute=False),
]


@pytest.mark.parametrize("policy", ["skip", "fail"])
def test_a_database_judges_as_spark_does(derby, policy):
    run, df = derby
    found = validate_pushed(run, "T", RULES, "derby", where='"id" > 3', as_of="2024-02-20", null_policy=policy)
    wanted = validate(df, [R(r.field, r.check_type, r.value, r.threshold, execute=r.execute, filter=r.filter and "s = 's1'") for r in RULES], where="id > 3", as_of="2024-02-20", null_policy=policy)
    for a, b in zip(found, wanted, strict=True):
        assert (a.rule_id, a.status, a.fail_count) == (b.rule_id, b.status, b.fail_count), a
        assert a.actual is None or float(a.actual) == pytest.approx(float(b.actual))
    assert found.total_rows == wanted.total_rows == 96 and found.generated_sql.startswith("SELECT\n  COUNT(*)") and found.engine == "derby"


def test_faulty_rules_are_errors_alone(derby):
    run, _ = derby
    asked = []
    rules = [R("gone", "is_positive"), R("n", "is_complete"), R("s", "has_pattern", "x"), R("*", "satisfies", "n >"), R("s", "is_greater_than", 1), R("id", "has_sum", 4950, 0), R("n,s", "are_unique"), R("*", "satisfies", '1 / "n" > 0')]
    report = validate_pushed(lambda sql: asked.append(sql) or run(sql), "T", rules, "derby")
    assert [r.status.value for r in report] == ["ERROR", "FAIL", "ERROR", "ERROR", "ERROR", "PASS", "ERROR", "ERROR"] and report[1].fail_count == 15 and len(asked) <= 13
    assert [r.status.value for r in validate_pushed(run, "T", rules[:1], "derby")] == ["ERROR"] and validate_pushed(run, "T", [], "derby").total_rows == 100
    with pytest.raises(Exception, match="NOWHERE"):
        validate_pushed(run, "NOWHERE", rules, "derby")
    with pytest.raises(ValueError, match="dialect"):
        validate_pushed(run, "T", rules, "cobol")


def test_polled_jobs():
    now, slept, cancelled = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def runner(states, limit=100.0):
        left = iter(states)
        return polled_runner(lambda sql: sql, lambda job: next(left), lambda job: {"RULE_0": 1, "TOTAL_ROWS": 3}, cancelled.append, limit, 1.0, lambda: now[0], sleep)

    assert runner(["queued", "RUNNING", "Succeeded"])("q") == {"rule_0": 1, "total_rows": 3} and slept == [1.0, 2.0]
    with pytest.raises(RuntimeError, match="FAILED"):
        runner(["RUNNING", "failed"])("q")
    with pytest.raises(TimeoutError):
        runner(["RUNNING"] * 99, limit=40.0)("q")
    assert cancelled == ["q"] and max(slept) <= 16
    with pytest.raises(TimeoutError):
        validate_pushed(runner(["RUNNING"] * 99, limit=5.0), "t", [R("a", "is_complete")], "athena")


def test_sessions_and_late_rows_of_a_stream(spark, tmp_path):
    """Sessions by state; what comes after the watermark is in none of them, and counted."""
    begin = datetime(2024, 1, 1)
    batches = [[("a", 0, 1), ("a", 9, 20), ("b", 0, 3)], [("a", 400, 2), ("b", 405, 1)], [("a", 5, 1), ("a", 407, 50), ("b", 500, 1)], [("c", 900, 1)]]
    source, windows, late = [], {}, {}
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, begin + timedelta(minutes=m), v) for k, m, v in rows], "k string, at timestamp, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, at timestamp, v int").parquet(str(tmp_path / "in"))
        sessions = windowed_metrics(stream, [R("v", "is_less_than", 10)], "at", None, "10 minutes", session_gap="15 minutes", by=["k"])
        query = sessions.writeStream.outputMode("append").foreachBatch(lambda b, n: source.extend(b.collect())).option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start()
        query.awaitTermination()
        with keyed_state(spark):
            counted = count_late(stream, "at", "10 minutes", ["k"]).writeStream.outputMode("update").foreachBatch(lambda b, n: late.update({r["k"]: (r["rows"], r["late"]) for r in b.collect()}))
            counted = counted.option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
        counted.awaitTermination()
    for r in source:
        windows[r["k"], r["window_start"]] = (r["total_rows"], r["fails"]["0:is_less_than:v"], (r["window_end"] - r["window_start"]).seconds // 60)
    assert windows == {
        ("a", begin): (2, 1, 24), ("b", begin): (1, 0, 15), ("a", begin + timedelta(minutes=400)): (2, 1, 22), ("b", begin + timedelta(minutes=405)): (1, 0, 15), ("b", begin + timedelta(minutes=500)): (1, 0, 15),
    }
    assert late == {"a": (5, 1), "b": (3, 0), "c": (1, 0)}
    with pytest.raises(ValueError, match="window"):
        windowed_metrics(spark.range(1), [], "id", None, "1 hour")


def test_warehouses(spark):
    name = f"memory:{uuid.uuid4().hex};create=true"
    house = warehouse("derby", database=name)
    df = spark.createDataFrame([(i, i % 5) for i in range(40)], "id int, n int")
    df.write.format("jdbc").options(url=house.url, dbtable="W").save()
    assert sorted(map(tuple, house.table(spark, "W").collect())) == sorted(map(tuple, df.collect()))
    parts = house.table(spark, "W", '"id"', 4)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 40 and sorted(map(tuple, parts.collect())) == sorted(map(tuple, df.collect()))
    assert [r.status.value for r in house.validate(spark, "W", [R("n", "is_less_than", 4, 0.8), R("n", "has_mean", 2, 0), R("n", "is_positive")])] == ["PASS", "PASS", "FAIL"]


def test_addresses():
    assert warehouse("postgres", {"user": "u"}, host="h", database="d").url == "jdbc:postgresql://h:5432/d"
    assert warehouse("snowflake", host="h", database="a b", warehouse="w").url == "jdbc:snowflake://h/?db=a%20b&schema=PUBLIC&warehouse=w"
    assert warehouse("athena", region="r", output="s3://x/").url == "jdbc:athena://Region=r;OutputLocation=s3://x/;Workgroup=primary"
    for kind in KINDS:
        assert warehouse(kind, host="h", database="d") if kind in ("postgres", "redshift", "doris") else kind
    for bad in ({"kind": "oracle"}, {"kind": "trino", "host": "h"}, {"kind": "derby", "database": "d", "host": "h"}):
        with pytest.raises(ValueError):
            warehouse(**bad)


def test_an_embedded_database_is_asked_by_the_driver(spark, monkeypatch):
    """No executor reads it: it may be in another JVM."""
    from tamis import queries
    from tamis.operators.pushdown import connection_runner

    connection = spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:memory:{uuid.uuid4().hex};create=true")
    row = connection_runner(connection)("SELECT CAST('x' AS VARCHAR(9)) AS s, CAST(NULL AS INT) AS n, 1.5 AS d, DATE('2024-01-02') AS day, TIMESTAMP('2024-01-02 03:04:05') AS moment FROM SYSIBM.SYSDUMMY1")
    connection.close()
    assert row["s"] == "x" and row["n"] is None and float(row["d"]) == 1.5 and row["day"].isoformat() == "2024-01-02" and row["moment"] == datetime(2024, 1, 2, 3, 4, 5)
    # Neither does the query: reading or writing over JDBC takes tasks.
    asked = []
    for side in (type(spark.read), type(spark.range(1).write)):
        monkeypatch.setattr(side, "format", lambda self, kind, old=side.format: asked.append(kind) or old(self, kind))
    assert queries.QUERIES["jdbc_pushdown"](spark, "/root/testdata/sf0.001").count() == 12 and "jdbc" not in asked
