import json
import shutil
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tamis import ColumnDef, OpenMetadataExport, SchemaDef, compile_rules_to_sql, detect_engine, extract_schema, get_capabilities, get_validation_sql, has_capability, list_engines_with_capability, load_data, load_jdbc, load_table, profile, require_capability, save_data, transpile, validate, validate_schema, validate_stream, windowed_metrics
from tamis import RuleDefinition as R
from tamis.cli import main
from tamis.functions.predicates import RuleError
from tamis.operators.profile import profile_df, sample
from tamis.operators.schema_contract import canonical_type
from tamis.plans import ddl
from tamis.plans.sqlgen import DIALECTS, results_from_row
from tamis.sources import scratch


@pytest.mark.parametrize(("name", "kind"), [("bigint", "integer"), ("decimal(10,2)", "float"), ("array<string>", "array"), ("struct<a:int>", "complex"), ("timestamp_ntz", "datetime"), ("datetime64[ns]", "datetime"), ("StringType", "string"), ("binary", "unknown")])
def test_type_names(name, kind):
    assert canonical_type(name) == kind


def test_contracts(spark):
    df = spark.createDataFrame([], "id bigint NOT NULL, price decimal(10,2), tags array<string>, who struct<name: string, at: timestamp_ntz>, m map<string,int>")
    assert validate_schema(df, SchemaDef.from_dict(extract_schema(df), strict=True))
    wanted = SchemaDef([
        ColumnDef("id", "int", nullable=False), ColumnDef("price", "float", nullable=False), ColumnDef("tags", "array", element_type="int"), ColumnDef("gone"), ColumnDef("maybe", optional=True),
        ColumnDef("who", "struct", fields=[ColumnDef("name", "int"), ColumnDef("x")], comment="person"),
    ], strict=True)
    found = validate_schema(df, wanted)
    assert not found and found.missing_columns == ["gone", "who.x"] and set(found.type_errors) == {"tags", "who.name"} and set(found.metadata_errors) == {"price", "who"} and found.extra_columns == ["who.at", "m"]
    assert found.to_dict()["total_issues"] == 8
    assert json.loads(extract_schema(df, as_json=True))["columns"][3]["fields"][1]["type"] == "datetime"
    rule = R("*", "validate_schema", {"columns": [{"name": "id", "type": "string"}]})
    assert validate(df, [rule])[0].status.value == "FAIL"


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", None), (3, None, {"k": 1}), (5, "a", None)], "n int, s string, m map<string,int>")
    p = profile(df)
    assert p["table_stats"]["total_rows"] == 3 and p["table_stats"]["columns_count"] == 3
    n, s = p["column_profiles"]["n"], p["column_profiles"]["s"]
    assert (n["min"], n["max"], n["mean"], n["std_dev"], n["sum"], n["distinct_count"]) == (1, 5, 3, 2, 9, 3)
    assert (s["null_count"], s["distinct_count"], s["uniqueness"], s["min"]) == (1, 1, 0.3333, None)
    assert profile_df(df.where("n < 0")).where("column = 's'").first()["completeness"] == 1
    assert sample(spark.range(1000), 0.1).count() < 200 and sample(spark.range(10), 100).count() == 10


def test_sql(spark):
    rules = [R("a", "is_positive"), R("a,b", "are_complete"), R("a", "has_sum", 3, 0), R("a", "is_complete", execute=False)]
    sql, ids = compile_rules_to_sql(rules, "t", "spark", where="a < 10")
    assert ids == ["0:is_positive:a", "1:are_complete:a,b", "2:has_sum:a"] and sql.endswith("WHERE a < 10")
    spark.createDataFrame([(1, None), (2, 3), (-1, 4), (20, 1)], "a int, b int").createOrReplaceTempView("t")
    row = spark.sql(sql).first().asDict()
    report = results_from_row(row, rules, 3)
    assert [r.status.value for r in report] == ["FAIL", "FAIL", "FAIL", "ERROR"] and [r.fail_count for r in report][:2] == [1, 1]
    assert compile_rules_to_sql([], "t") == ("", [])
    assert '"a"' in get_validation_sql(rules, "t", "trino")
    with pytest.raises(ValueError):
        compile_rules_to_sql(rules, "t", "cobol")
    for dialect in ("snowflake", "bigquery", "redshift", "trino", "doris", "athena", "postgres"):
        assert "rule_0" in get_validation_sql([R("d", "is_on_monday"), R("d", "is_yesterday"), R("s", "has_pattern", "a'b")], "db.t", dialect)
    assert transpile("select 1", "spark", "duckdb", spark) == "SELECT\n  1"
    with pytest.raises(NotImplementedError):
        transpile("select 1", "mysql", "duckdb")


DIALECT_RULES = [R("a", "is_positive", filter="b > 1"), R("a", "has_sum", 1, filter="b > 1"), R("a,b", "is_composite_key", filter="b > 1")]


@pytest.mark.parametrize("dialect", [d for d in DIALECTS if d not in ("redshift", "derby")])
def test_sql_that_every_dialect_has(dialect):
    sql = compile_rules_to_sql(DIALECT_RULES, "t", dialect, counts=True)[0]
    assert "FILTER" not in sql and "rows_0" in sql and "fails_0" in sql and "rows_1" not in sql


def test_sql_of_dialects():
    def sql(dialect, rule):
        return get_validation_sql([rule], "t", dialect)

    form, key = R("d", "validate_date_format", "%d/%m/%Y %H:%M"), R("a,b", "is_composite_key")
    assert "'%d/%m/%Y %H:%i'" in sql("trino", form) and "STR_TO_DATE" in sql("doris", form) and "SAFE.PARSE_TIMESTAMP('%d/%m/%Y %H:%M'" in sql("bigquery", form)
    assert "'DD/MM/YYYY HH24:MI'" in sql("snowflake", form) and "TRY_STRPTIME" in sql("duckdb", form)
    for dialect in ("postgres", "redshift"):
        with pytest.raises(RuleError):
            sql(dialect, form)
    with pytest.raises(RuleError):
        sql("duckdb", R("d", "validate_date_format", "dd/MM/yyyy"))
    assert "pg_input_is_valid" in sql("postgres", R("d", "is_past_date")) and "COUNT(DISTINCT (" in sql("postgres", key) and "TO_JSON_STRING(STRUCT(" in sql("bigquery", key)
    with pytest.raises(RuleError):
        sql("redshift", key)


def test_exact_counts_of_an_emitted_row(spark):
    import duckdb

    rows = [(i, i % 7, None if i % 5 == 0 else i - 40) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, g int, v int")
    df.createOrReplaceTempView("counted")
    rules = [R("v", "is_positive", filter="g = 3"), R("v", "is_complete"), R("v", "has_sum", 1, filter="g = 3"), R("v", "is_positive", filter="g = 99")]
    wanted = [(r.total_rows, r.fail_count) for r in validate(df, rules)]
    spark_row = spark.sql(compile_rules_to_sql(rules, "counted", "spark", counts=True)[0]).first().asDict()
    counted = df.toPandas()  # noqa: F841
    duck_row = duckdb.sql(compile_rules_to_sql(rules, "counted", "duckdb", counts=True)[0]).df().iloc[0].to_dict()
    for row in (spark_row, duck_row):
        report = results_from_row(row, rules, 100)
        assert [(r.total_rows, r.fail_count) for i, r in enumerate(report) if i != 2] == [w for i, w in enumerate(wanted) if i != 2]
    assert results_from_row({k: v for k, v in spark_row.items() if k.startswith("rule")}, rules, 100)[0].fail_count is None


def test_capabilities(spark):
    import pandas as pd

    assert detect_engine(spark.range(1)) == "pyspark" and has_capability("pyspark", "bifurcation") and not has_capability("pyspark", "nope") and get_capabilities("other") == {}
    assert list_engines_with_capability("streaming") == ["pyspark"] and list_engines_with_capability("nope") == []
    require_capability(spark.range(1), "profiling")
    with pytest.raises(NotImplementedError, match="time travel"):
        require_capability(spark.range(1), "nope", "time travel")
    with pytest.raises(TypeError):
        detect_engine(pd.DataFrame())


def test_tables_by_name(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert load_table(spark, "three").count() == 3 and validate("three", [R("id", "is_complete")]).total_rows == 3


@pytest.mark.parametrize(("bounds", "wanted"), [((3, 99), {"column": "id", "lowerBound": 3, "upperBound": 100, "numPartitions": 8}), ((None, None), {}), ("no key", {})])
def test_jdbc(bounds, wanted):
    """What Spark's reader is asked for: no driver is here."""
    asked = []

    class Reader:
        def jdbc(self, url, table, **options):
            asked.append((url, table, options))
            return SimpleNamespace(first=lambda: bounds)

    load_jdbc(SimpleNamespace(read=Reader()), "jdbc:x", "t", None if bounds == "no key" else "id", 8, {"user": "u"})
    assert asked[-1] == ("jdbc:x", "t", {"properties": {"user": "u"}} | wanted)
    assert len(asked) == (1 if bounds == "no key" else 2)


def test_scratch(spark):
    kept, gone = (scratch.materialise(spark.range(4), n) for n in ("kept", "gone"))
    path = scratch._PATHS[gone]
    scratch.discard(gone)
    assert kept.count() == 4 and not Path(path).exists() and Path(scratch._PATHS[kept]).exists()
    elsewhere = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(applicationId="a", master="spark://x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(elsewhere)


def test_for_each(spark, sf, tmp_path):
    shutil.copy(f"{sf}/events.parquet", tmp_path / "events.parquet")
    batch = spark.read.parquet(str(tmp_path / "events.parquet"))
    counts = []
    checked = validate_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "*.parquet")), RULES)
    checked.for_each(lambda good, bad, n: counts.append((good.count(), bad.count())), str(tmp_path / "state")).awaitTermination()
    good, bad = validate(batch, RULES[:2]).split("all_rules")
    assert [sum(x) for x in zip(*counts, strict=True)] == [good.count(), bad.count()]


def test_ddl(spark):
    import duckdb

    assert len(ddl.list_dialects()) == 17 and ddl.list_tables() == ["rules", "schema_registry"]
    for d in ddl.list_dialects():
        assert "check_type" in ddl.generate("rules", d)
    duckdb.sql(ddl.generate("rules", "duckdb"))
    spark.sql(ddl.generate("rules", "spark", using="parquet"))
    assert spark.table("rules").columns[:2] == ["id", "environment"]
    spark.sql("DROP TABLE rules")
    assert "PARTITION BY day\nCLUSTER BY a, b" in ddl.generate("rules", "bigquery", partition_by="day", cluster_by=["a", "b"])
    assert ddl.generate("all", "postgresql", "dq").count("CREATE TABLE dq.") == 2
    for bad in (("rules", "cobol"), ("nope", "spark")):
        with pytest.raises(ValueError):
            ddl.generate(*bad)


@pytest.mark.parametrize("name", ["t.csv", "t.parquet", "t.jsonl", "t.orc"])
def test_files(spark, tmp_path, name):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    save_data(df, str(tmp_path / name))
    assert sorted(map(tuple, load_data(spark, str(tmp_path / name)).select("n", "s").collect())) == [(1, "a"), (2, None)]


def test_file_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_data(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        load_data(spark, str(tmp_path / "none.xyz"))
    with pytest.raises(ValueError):
        save_data(spark.range(1), str(tmp_path / "x.txt"))
    (tmp_path / "whole.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert load_data(spark, str(tmp_path / "whole.json")).count() == 2


RULES = [R("value", "is_between", [10, 90]), R("props", "is_legit"), R("event_id", "is_unique"), R("value", "has_sum", 1)]


def test_stream_equals_batch(spark, sf, tmp_path):
    shutil.copy(f"{sf}/events.parquet", tmp_path / "events.parquet")
    batch = spark.read.parquet(str(tmp_path / "events.parquet"))
    checked = validate_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "*.parquet")), RULES)
    assert [e.check_type for e in checked.errors] == ["is_unique", "has_sum"]
    checked.write(*(str(tmp_path / x) for x in ("good", "bad", "state"))).awaitTermination()
    good, bad = validate(batch, RULES[:2]).split("all_rules")
    assert spark.read.parquet(str(tmp_path / "good")).drop("batch").exceptAll(good).count() == 0
    assert spark.read.parquet(str(tmp_path / "bad")).count() == bad.count() > 0
    assert windowed_metrics(batch, RULES, "ts", "1 day", "1 hour").agg(F.sum("total_rows")).first()[0] == batch.count()


def test_windowed_metrics_on_a_stream(spark, sf, tmp_path):
    shutil.copy(f"{sf}/events.parquet", tmp_path / "events.parquet")
    batch = spark.read.parquet(str(tmp_path / "events.parquet"))
    stream = windowed_metrics(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "*.parquet")), RULES, "ts", "1 day", "1 hour")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("total_rows")).first()[0] == batch.count()


def test_export(spark):
    df = spark.createDataFrame([(1,), (None,)], "n int")
    report = validate(df, [R("n", "is_complete"), R("gone", "is_complete"), R("n", "has_min", 1, 0)])
    out = OpenMetadataExport("db.t").validation(report)
    assert [r["payload"]["testCaseStatus"] for r in out["results"]] == ["Failed", "Failed", "Success"]
    assert out["definitions"][0]["entityLink"] == "<#E::table::db.t::columns::n>" and out["definitions"][2]["entityLink"] == "<#E::table::db.t>"
    p = OpenMetadataExport("db.t").profile(profile(df))
    assert p["rowCount"] == 2 and p["columnProfile"][0]["nullCount"] == 1


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "d.csv").write_text("id,email\n1,a\n2,\n")
    (tmp_path / "r.csv").write_text("field,check_type,threshold\nemail,is_complete,1.0\nid,is_unique,1.0\n")
    data, rules = str(tmp_path / "d.csv"), str(tmp_path / "r.csv")
    assert main(["validate", data, rules, "--fail-on-error", "--quarantine", str(tmp_path / "bad.parquet")]) == 1
    assert "1 passed, 1 failed" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "bad.parquet")).count() == 1
    assert main(["validate", data, rules, "--format", "json", "-o", str(tmp_path / "o.json")]) == 0
    assert json.loads((tmp_path / "o.json").read_text())["failed"] == 1
    assert main(["sql", rules, "--table", "t"]) == 0 and "rule_0" in capsys.readouterr().out
    assert main(["ddl", "--dialect", "mysql"]) == 0 and main(["rules"]) == 0 and main(["profile", data]) == 0 and main(["schema", data]) == 0
    assert main(["validate", str(tmp_path / "no.csv"), rules]) == 2
