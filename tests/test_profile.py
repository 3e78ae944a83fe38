from pyspark.sql import functions as F

from conftest import rows
from tideline.operators.derive import (
    addable_columns,
    days_since_min,
    derived_columns,
    per_subject,
    select_plot_columns,
)
from tideline.operators.profile import (
    distinct_values,
    preview,
    profile,
    reconcile,
    sample_values,
    subject_counts,
)
from tideline.roles import Roles


def test_distinct_values_preview(spark):
    df = spark.range(0, 45).select((F.col("id") % 35).alias("v"))
    r = distinct_values(df, "v").first()
    assert r["n_values"] == 35
    assert r["preview"] == ", ".join(str(i) for i in range(30)) + "..."
    r = distinct_values(spark.createDataFrame([("b",), ("a",), (None,)], "v string"), "v").first()
    assert (r["n_values"], r["preview"]) == (2, "a, b")


def test_sample_values(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None), (10, "b"), (1, "z")],
                               "n int, s string")
    got = rows(sample_values(df, k=3))
    assert got == sorted([("n", 1, "1"), ("n", 2, "2"), ("n", 3, "3"),
                          ("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c")], key=repr)


def test_profile_exact_and_approx(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "n int, s string")
    exact = rows(profile(df, exact=True))
    assert exact == [(0, "n", "int", 3, 2), (1, "s", "string", 2, 2)]
    assert rows(profile(df)) == exact


def test_subject_counts_and_reconcile(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    r = subject_counts(df, "s").first()
    assert (r["n_rows"], r["n_subjects"], r["rows_per_subject"]) == (4, 2, 2.0)
    r = reconcile(df, df.filter("s = 'a'")).first()
    assert tuple(r) == (4, 1, 2, 1, False)


def test_plot_columns(spark):
    # C14
    base = spark.createDataFrame([("a", 1, 2.0, "x")], "USUBJID string, ADY int, DUR double, R string")
    df = base.withColumn("NEW", F.lit(1))
    roles = Roles(subject="USUBJID", x="ADY", bar="DUR", keep=("ADY", "R"))
    out = select_plot_columns(df, roles, base.columns)
    assert out.columns == ["USUBJID", "ADY", "DUR", "R", "NEW"]
    assert out.count() == 1
    assert derived_columns(df, base.columns) == ["NEW"]
    assert addable_columns(df, roles) == ["R", "NEW"]


def test_per_subject(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3), (None, 7), (None, 2)], "s string, v int")
    j = rows(per_subject(df, "s", {"mx": F.max("v")}))
    assert j == sorted([("a", 1, 5), ("a", 5, 5), ("b", 3, 3), (None, 7, 7), (None, 2, 7)], key=repr)


def test_days_since_min(spark):
    import datetime as dt
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 1, 12)), ("a", dt.datetime(2020, 1, 3, 6)),
                                ("b", dt.datetime(2020, 1, 2, 13))], "s string, t timestamp_ntz")
    assert rows(days_since_min(df, "t"), "s", "days_since_min") == [("a", 0), ("a", 1), ("b", 1)]
    assert rows(days_since_min(df, "t", by="s", inclusive=True), "s", "days_since_min") == \
        [("a", 1), ("a", 2), ("b", 1)]


def test_preview(spark):
    df = spark.range(0, 100)
    assert [r[0] for r in preview(df, 3, [F.col("id").desc()]).collect()] == [99, 98, 97]


def test_bar_to_days(spark):
    import datetime as dt
    from tideline.operators.derive import bar_to_days
    df = spark.createDataFrame([(dt.date(2020, 1, 1), dt.datetime(2020, 1, 11, 5))],
                               "start date, endt timestamp_ntz")
    out = bar_to_days(df, "endt", "start", inclusive=True)
    assert out.first()["endt"] == 11
    out = bar_to_days(df, "endt", F.lit(dt.datetime(2020, 1, 10)), name="d")
    assert out.first()["d"] == 1


def test_plot_columns_without_merged_and_lineage_frame(spark):
    from tideline.operators.derive import derive, lineage_frame
    base = spark.createDataFrame([("a", 1, 2.0)], "USUBJID string, ADY int, DUR double")
    merged = base.withColumn("TRT01P", F.lit("X"))
    df, lin = derive(merged, {"NEW": "ADY + 1"}, request="add one")
    roles = Roles(subject="USUBJID", x="ADY", bar="DUR")
    out = select_plot_columns(df, roles, base.columns, include_merged=False, merged_cols=["TRT01P"])
    assert out.columns == ["USUBJID", "ADY", "DUR", "NEW"]
    r = lineage_frame(spark, lin, 1, 1).first()
    assert (r["request"], r["derived"], r["formulas"]) == ("add one", ["NEW"], {"NEW": "ADY + 1"})


def test_not_null_drops_nan(spark):
    from tideline.operators.derive import not_null
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in not_null(df, "v").collect()] == [1.0]


def test_group_agg_and_column_min(spark):
    from tideline.operators.profile import column_min, group_agg
    df = spark.createDataFrame([("X", 1, 5), ("X", 2, 3), ("Y", 3, None)], "arm string, s int, v int")
    got = rows(group_agg(df, "arm", {"n": F.count(F.lit(1)), "mn": F.min("v")}))
    assert got == [("X", 2, 3), ("Y", 1, None)]
    assert column_min(df, "v").first()[0] == 3


def test_require_subject_id():
    import pytest
    from tideline.operators.derive import InvalidSubjectRole, require_subject_id
    require_subject_id(Roles(subject="USUBJID", x="ADY", bar="DUR"))
    with pytest.raises(InvalidSubjectRole):
        require_subject_id(Roles(subject="AGE", x="ADY", bar="DUR"))
