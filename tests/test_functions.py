import datetime as dt

from pyspark.sql import functions as F

from tideline.functions import (
    bar_label,
    day_diff,
    elapsed_days,
    shift_days,
    to_number,
    to_timestamp_lenient,
)


def _pair(spark, a, b, kind="timestamp_ntz"):
    return spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")


def test_day_diff_floors_sub_day_spans(spark):
    # 23:00 -> 01:00 next day is 0 whole days, not 1
    df = _pair(spark, dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 2, 1))
    assert df.select(day_diff("a", "b")).first()[0] == 0


def test_day_diff_negative_floors_toward_minus_infinity(spark):
    # 23:00 back to 12:00 the same day is -1; elapsed -11/24
    df = _pair(spark, dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 1, 12))
    r = df.select(day_diff("a", "b").alias("d"), elapsed_days("a", "b").alias("e")).first()
    assert r["d"] == -1
    assert abs(r["e"] - (-11 / 24)) < 1e-12


def test_day_diff_inclusive_same_day_is_one(spark):
    # C9
    df = _pair(spark, dt.datetime(2020, 1, 1, 8), dt.datetime(2020, 1, 1, 9))
    assert df.select(day_diff("a", "b", inclusive=True)).first()[0] == 1


def test_day_diff_on_dates_and_timestamps(spark):
    df = _pair(spark, dt.date(2020, 1, 1), dt.date(2020, 3, 1), kind="date")
    assert df.select(day_diff("a", "b")).first()[0] == 60
    tz = spark.createDataFrame([(dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 3, 12))],
                               "a timestamp, b timestamp")
    assert tz.select(day_diff("a", "b")).first()[0] == 2


def test_to_number_matches_lenient_numeric_parse(spark):
    # C10
    vals = ["1", " 2 ", "1e3", "x", "", None, "12d", "1,000", "0x10", "1f", "NaN", "-3.5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_number("s")).collect()]
    assert got == [1.0, 2.0, 1000.0, None, None, None, None, None, None, None, None, -3.5]


def test_bar_label(spark):
    # 12 (bigint) -> 12d, 12.0 -> 12.0d, null stays null
    df = spark.createDataFrame([(12, 12.0), (None, None)], "i bigint, f double")
    got = df.select(bar_label("i"), bar_label("f")).collect()
    assert [tuple(r) for r in got] == [("12d", "12.0d"), (None, None)]


def test_to_timestamp_lenient_layouts(spark):
    vals = ["2020-01-02", "2020", "20200103", "01JAN2020", "01/04/2020", "12", "12345", "PR", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_timestamp_lenient("s")).collect()]
    assert got[:5] == [dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 3),
                       dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 4)]
    assert got[5:] == [None, None, None, None]


def test_shift_days(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 30, 6), dt.date(2020, 2, 28))],
                               "t timestamp_ntz, d date")
    r = df.select(shift_days("t", 3).alias("t3"), shift_days("d", 2, kind="date").alias("d2"),
                  shift_days("t", F.lit(-1)).alias("tm")).first()
    assert r["t3"] == dt.datetime(2020, 2, 2, 6)
    assert r["d2"] == dt.date(2020, 3, 1)
    assert r["tm"] == dt.datetime(2020, 1, 29, 6)


def test_interval_days_floors(spark):
    from tideline.functions import interval_days
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 1, 12)),
                                (dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 3, 6))],
                               "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(interval_days(F.col("b") - F.col("a"))).collect()]
    assert got == [-1, 2]
