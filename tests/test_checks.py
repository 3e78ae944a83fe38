import datetime as dt

import pytest

from conftest import rows
from tideline.operators.checks import (
    ValidationFailed,
    check_list,
    column_types,
    missing_columns,
    require_columns,
    require_valid,
    summarize,
    validate_all,
    validation_report,
)
from tideline.roles import Roles


def _col(spark, vals, kind="string"):
    return spark.createDataFrame([(v,) for v in vals], f"c {kind}")


@pytest.mark.parametrize("vals,expected", [
    (["2020-01-01", "2020-02-03T10:00", None], "date_string"),
    (["2020", "2021"], "date_string"),
    (["20200101"], "date_string"),
    (["01JAN2020"], "date_string"),
    (["12", "100"], "numeric_string"),
    (["PR", "CR"], "non_linear"),
    ([None, None], "no_values"),
])
def test_axis_type_of_text(spark, vals, expected):
    # C11
    got = column_types(_col(spark, vals), ["c"]).first()
    assert got["axis_type"] == expected


def test_axis_and_bar_types_of_typed_columns(spark):
    df = spark.createDataFrame([(1, 2.0, True, dt.datetime(2020, 1, 1), dt.date(2020, 1, 1), [1])],
                               "i int, d double, b boolean, t timestamp, dd date, a array<int>")
    got = {r["column_name"]: (r["axis_type"], r["bar_type"]) for r in column_types(df).collect()}
    assert got == {"i": ("numeric", "numeric"), "d": ("numeric", "numeric"),
                   "b": ("numeric", "numeric"), "t": ("datetime", "datetime"),
                   "dd": ("datetime", "datetime"), "a": ("non_linear", "non_numeric")}


@pytest.mark.parametrize("vals,expected", [
    (["1", "2.5", None], "numeric"),
    (["1", "x"], "non_numeric"),
    (["12d"], "non_numeric"),
])
def test_bar_type_of_text(spark, vals, expected):
    # C12
    assert column_types(_col(spark, vals), ["c"]).first()["bar_type"] == expected


def test_validate_short_circuits(spark):
    # C13
    df = spark.createDataFrame([("a", 1, 2)], "s string, x int, b int")
    r = summarize(validate_all(df, Roles(subject="s", x="", bar="b")))
    assert r == {"valid": False, "errors": ["Roles without a column: X-axis (linear)"],
                 "warnings": []}
    r = summarize(validate_all(df, Roles(subject="s", x="nope", bar="b")))
    assert r["errors"] == ["Role columns that the table lacks: X-axis ('nope')"]
    empty = df.filter("false")
    r = summarize(validate_all(empty, Roles(subject="s", x="x", bar="b")))
    assert r["errors"] == ["No data"]


def test_validate_warnings_and_errors(spark):
    df = spark.createDataFrame([("a", "2020-01-01", dt.datetime(2020, 1, 5), "x")],
                               "s string, x string, b timestamp, bad string")
    report = validate_all(df, Roles(subject="s", x="x", bar="b"))
    r = require_valid(report)
    assert r["valid"] and len(r["warnings"]) == 2
    labels = rows(check_list(report))
    assert labels == sorted([("All required variables selected", True, None),
                             ("X-axis is numeric/linear", True, "Type: date_string"),
                             ("HBAR is numeric", True, "Type: datetime")], key=repr)
    bad = validate_all(df, Roles(subject="s", x="bad", bar="bad"),
                       graph_request="Please filter subjects older than 60")
    with pytest.raises(ValidationFailed):
        require_valid(bad)
    r = summarize(bad)
    assert len(r["errors"]) == 3
    assert "The plot request asks for data work: filter subjects" in r["errors"]


def test_require_columns_and_missing(spark):
    df = spark.createDataFrame([("a", 1)], "s string, x int")
    roles = Roles(subject="s", x="x", bar="b")
    assert missing_columns(df, ["s", "b"]) == ["b"]
    assert require_columns(df, roles) == ["b"]
    with pytest.raises(ValidationFailed):
        require_columns(df, roles, strict=True)


def test_validation_report(spark):
    orig = spark.createDataFrame([("a", 1, 3.0), ("b", 2, 4.0), ("a", 3, None)],
                                 "s string, x int, b double")
    df = orig.withColumn("x2", orig.x * 2)
    lineage = {"request": "double x", "derived": ["x2"], "formulas": {"x2": "x * 2"}}
    rep = validation_report(df, Roles(subject="s", x="x", bar="b"), lineage, original=orig,
                            n_preview=2).first()
    assert rep["original_shape"]["rows"] == 3 and rep["original_shape"]["cols"] == 3
    assert rep["processed_shape"]["cols"] == 4
    assert rep["derived"] == ["x2"] and rep["formulas"] == {"x2": "x * 2"}
    assert rep["first_rows"] == ['{"s":"a","x":1,"b":3.0,"x2":2}', '{"s":"a","x":3,"x2":6}']
    assert rep["dtypes"]["x2"] == "int" and rep["roles"]["bar"] == "b"


def test_single_column_type_wrappers(spark):
    from tideline.operators.checks import axis_type, bar_type
    df = spark.createDataFrame([("2020-01-01", "5")], "x string, b string")
    assert axis_type(df, "x").first()["axis_type"] == "date_string"
    assert bar_type(df, "b").first()["bar_type"] == "numeric"
