from datetime import date, datetime

import pytest

from tamis import RuleDefinition as R
from tamis import list_rules, load_rules_csv, save_rules_csv
from tamis.rules import MANIFEST, parse_field, parse_value
from tamis.sources.rules_store import check_rule_dict, check_rules_columns, load_rules


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        (None, None), ("NULL", None), ("", None), ("12", 12), ("1.5", 1.5), ("abc", "abc"), ("2024-02-29", date(2024, 2, 29)), ("29/02/2024", date(2024, 2, 29)), ("2024-13-45", "2024-13-45"),
        ("[1, 2]", [1, 2]), ("['a','b']", ["a", "b"]), ("[a, b]", ["a", "b"]), (["1", "x"], [1, "x"]), (3, 3), ("[]", []),
    ],
)
def test_values(raw, value):
    assert parse_value(raw) == value


@pytest.mark.parametrize(("raw", "field"), [("a", "a"), ("a, b", ["a", "b"]), ("[a,b]", ["a", "b"]), ("['a']", "a"), (["a"], "a"), (["a", "b"], ["a", "b"]), ("", "")])
def test_fields(raw, field):
    assert parse_field(raw) == field


def test_level_and_category_come_from_the_manifest():
    r = R("x", "has_min", 1, level="ROW", category="nonsense")
    assert (r.level, r.category) == ("TABLE", "aggregation")
    with pytest.raises(ValueError, match="unknown check_type"):
        R("x", "no_such_check")


def test_manifest_has_all_checks():
    names = [n for n in MANIFEST if n not in ("is_equal_to_column", "logic_check")]
    assert len([n for n in names if MANIFEST[n].category != "custom"]) == 54
    assert len(list_rules("TABLE")) == 9
    assert "is_unique" not in list_rules(streaming=True) and "are_complete" in list_rules(streaming=True)


def test_dictionaries():
    r = R.from_dict({"field": "a", "check_type": "is_in", "value": "[1,2]", "threshold": "0.5", "execute": "no", "updated_at": "2024-01-02T03:04:05", "owner": "me"})
    assert (r.value, r.threshold, r.execute, r.updated_at, r.metadata) == ([1, 2], 0.5, False, datetime(2024, 1, 2, 3, 4, 5), {"owner": "me"})
    assert r.to_dict()["owner"] == "me" and r.to_dict()["updated_at"] == "2024-01-02T03:04:05"
    assert R.from_dict({"field": "a", "check_type": "satisfies", "value": "5"}).value == "5"
    assert R.from_dict({"field": "a", "check_type": "is_complete", "threshold": "x"}).threshold == 1.0
    with pytest.raises(ValueError):
        R.from_dict({"field": "a"})


def test_csv_round_trip(tmp_path):
    rules = [R("a", "is_between", [1, 2.5], 0.9), R("a,b", "are_complete"), R("s", "is_in", ["x", "y,z"]), R("d", "is_date_after", date(2024, 1, 2)), R("s", "has_pattern", "^a,\"b\"$", execute=False), R("t", "has_sum", 10, filter="a > 1")]
    save_rules_csv(rules, tmp_path / "r.csv")
    back = load_rules_csv(tmp_path / "r.csv")
    assert [(r.field, r.check_type, r.value, r.threshold, r.execute, r.filter) for r in back] == [(r.field, r.check_type, r.value, r.threshold, r.execute, r.filter) for r in rules]
    texts = [R("s", "is_equal", x) for x in ("10", "1.0", "true", "null", "2024-01-02", "[a]", '"q"', " x ", "a,b")] + [R("n", "is_equal", x) for x in (10, 1.5, True, date(2024, 1, 2))]
    marked = R("s", "is_complete", updated_at=datetime(2024, 1, 2, 3, 4, 5), metadata={"owner": "me", "team": "x, y"})
    save_rules_csv([*texts, marked], tmp_path / "t.csv")
    again = load_rules_csv(tmp_path / "t.csv")
    assert [(r.value, type(r.value)) for r in again[:-1]] == [(r.value, type(r.value)) for r in texts]
    assert (again[-1].updated_at, again[-1].metadata) == (marked.updated_at, marked.metadata)
    (tmp_path / "bad.csv").write_text("field,value\na,1\n")
    with pytest.raises(ValueError, match="check_type"):
        load_rules_csv(tmp_path / "bad.csv")
    (tmp_path / "list.csv").write_text("field,check_type,value\ns,is_in,\"['a','b']\"\n")
    assert load_rules_csv(tmp_path / "list.csv")[0].value == ["a", "b"]


def test_rules_tables(spark):
    df = spark.createDataFrame([("a", "is_in", "[1,2]", None)], "field string, check_type string, value string, threshold string")
    assert load_rules(df)[0].value == [1, 2]
    with pytest.raises(ValueError):
        check_rules_columns(df.drop("field"))
    with pytest.raises(TypeError):
        check_rules_columns(3)
    for bad in ({"field": "a"}, {"field": " ", "check_type": "x"}):
        with pytest.raises(ValueError):
            check_rule_dict(bad)


def test_types_that_nobody_knows_are_no_errors():
    from tamis import SchemaDef, validate_schema
    from pyspark.sql import types as T

    found = validate_schema(T.StructType([T.StructField("a", T.LongType())]), SchemaDef.from_dict({"columns": [{"name": "a", "type": "uuid"}, {"name": "b", "type": "uuid"}]}))
    assert found.type_errors == {} and found.missing_columns == ["b"]
