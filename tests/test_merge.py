import pytest
from pyspark.sql import functions as F

from conftest import rows
from tideline.operators.merge import (
    MissingColumns,
    RowCountChanged,
    check_row_count,
    first_per_key,
    merge_subjects,
    merge_with_counts,
    orphan_markers,
    resolve_columns,
)


def test_first_per_key_orders_with_nulls_last(spark):
    df = spark.createDataFrame(
        [("A", 3, "a3"), ("A", 1, "a1"), ("A", None, "an"), ("B", None, "bn"), ("B", 2, "b2"),
         ("C", None, "cn"), (None, 5, "n5"), (None, 4, "n4")],
        "k string, o int, v string")
    got = rows(first_per_key(df, "k", order=["o"]), "k", "v")
    assert got == sorted([("A", "a1"), ("B", "b2"), ("C", "cn"), (None, "n4")], key=repr)


def test_first_per_key_window_method_and_descending(spark):
    df = spark.createDataFrame([("A", 3, "a3"), ("A", 1, "a1"), ("B", 2, "b2")],
                               "k string, o int, v string")
    assert rows(first_per_key(df, "k", order=["o"], method="window"), "k", "v") == \
        [("A", "a1"), ("B", "b2")]
    assert rows(first_per_key(df, "k", order=[("o", "desc")]), "k", "v") == \
        [("A", "a3"), ("B", "b2")]


def test_first_per_key_independent_of_partitioning(spark):
    df = spark.range(0, 2000).select(
        (F.col("id") % 37).alias("k"), (F.col("id") * 7919 % 1000).alias("o"),
        F.col("id").alias("v"))
    a = rows(first_per_key(df, "k", order=["o"]))
    b = rows(first_per_key(df.repartition(13), "k", order=["o"]))
    c = rows(first_per_key(df.coalesce(1), "k", order=["o"], method="window"))
    assert a == b == c


def test_merge_null_keys(spark):
    # C4
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", "A"), (None, "N")], "k string, s string")
    default = rows(merge_subjects(left, right, "k"), "k", "x", "s")
    assert default == sorted([("a", 1, "A"), (None, 2, None)], key=repr)
    matched = rows(merge_subjects(left, right, "k", null_keys="match"), "k", "x", "s")
    assert matched == sorted([("a", 1, "A"), (None, 2, "N")], key=repr)


def test_merge_renames_clashing_columns(spark):
    # C5
    left = spark.createDataFrame([("a", "rec")], "USUBJID string, S string")
    right = spark.createDataFrame([("a", "subj")], "USUBJID string, S string")
    out = merge_subjects(left, right)
    assert out.columns == ["USUBJID", "S", "S_subj"]
    assert out.select("S", "S_subj").first() == ("rec", "subj")


def test_merge_dedups_subjects_and_keeps_row_count(spark):
    # C6
    records = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "USUBJID string, v int")
    subjects = spark.createDataFrame(
        [("a", "2021-01-02", "late"), ("a", "2021-01-01", "early"), ("b", "2021-05-01", "only")],
        "USUBJID string, d string, arm string")
    merged, before, after = merge_with_counts(records, subjects, order=["d"])
    got = rows(merged, "USUBJID", "v", "arm")
    assert got == [("a", 1, "early"), ("a", 2, "early"), ("b", 3, "only")]
    assert check_row_count(before, after) == 3


def test_check_row_count_raises_on_change(spark):
    records = spark.createDataFrame([("a", 1)], "USUBJID string, v int")
    subjects = spark.createDataFrame([("a", "x"), ("a", "y")], "USUBJID string, arm string")
    merged, before, after = merge_with_counts(records, subjects, dedup=False)
    merged.collect()
    with pytest.raises(RowCountChanged):
        check_row_count(before, after)


def test_merge_with_different_key_names(spark):
    records = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "rk bigint, v string")
    subjects = spark.createDataFrame([(1, "A"), (2, "B")], "sk bigint, arm string")
    out = merge_subjects(records, subjects, ("rk", "sk"))
    assert out.columns == ["rk", "v", "arm"]
    assert rows(out) == sorted([(1, "x", "A"), (2, "y", "B"), (3, "z", None)], key=repr)


def test_resolve_columns(spark):
    records = spark.createDataFrame([("a", 1)], "USUBJID string, v int")
    subjects = spark.createDataFrame([("a", "x")], "USUBJID string, arm string")
    assert resolve_columns(["v", "arm"], records, subjects) == [("v", "records"), ("arm", "subjects")]
    with pytest.raises(MissingColumns):
        resolve_columns(["nope"], records, subjects)
    assert resolve_columns(["nope"], records, subjects, strict=False) == [("nope", None)]


def test_orphan_markers(spark):
    # C16
    bars = spark.createDataFrame([("A", 10.0), ("B", 5.0)], "s string, bar double")
    markers = spark.createDataFrame([("A", 1.0), ("Z", 2.0)], "s string, x double")
    assert rows(orphan_markers(markers, bars, "s")) == [("Z", 2.0)]
