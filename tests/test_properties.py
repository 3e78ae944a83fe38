"""Properties from the test strategy: hold for any input, order or partitioning."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators.merge import first_per_key, merge_subjects, orphan_markers
from tideline.operators.timeline import category_markers, lane_order, subject_bars

KEYS = st.one_of(st.none(), st.integers(0, 6))
VALS = st.one_of(st.none(), st.integers(-5, 5))
RECORDS = st.lists(st.tuples(KEYS, VALS), min_size=1, max_size=40)
SUBJECTS = st.lists(st.tuples(KEYS, st.sampled_from(["A", "B", "C"])), max_size=12)
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _rec(spark, data):
    return spark.createDataFrame(data, "k int, v int")


@SETTINGS
@given(records=RECORDS, subjects=SUBJECTS, match=st.booleans(), split=st.booleans())
def test_merge_keeps_every_record(spark, records, subjects, match, split):
    rec = _rec(spark, records)
    sub = spark.createDataFrame(subjects, "k int, arm string")
    merged = merge_subjects(rec, sub, "k", order=["arm"],
                            null_keys="match" if match else "no_match", split_hot=split)
    assert merged.count() == len(records)
    assert sorted(merged.select("k", "v").collect(), key=repr) == sorted(rec.collect(), key=repr)


@SETTINGS
@given(records=RECORDS)
def test_one_bar_per_subject_with_smallest_value(spark, records):
    bars = {r["k"]: r["v"] for r in subject_bars(_rec(spark, records), "k", "v").collect()}
    expected = {}
    for k, v in records:
        expected.setdefault(k, None)
        if v is not None and (expected[k] is None or v < expected[k]):
            expected[k] = v
    assert bars == expected


@SETTINGS
@given(records=RECORDS, parts=st.integers(1, 5), seed=st.integers(0, 99))
def test_lane_order_is_a_permutation_independent_of_partitioning(spark, records, parts, seed):
    shuffled = list(records)
    random.Random(seed).shuffle(shuffled)
    bars = subject_bars(_rec(spark, shuffled).repartition(parts), "k", "v")
    got = {r["k"]: r["lane"] for r in lane_order(bars, "k", "v", num_partitions=parts).collect()}
    w = Window.orderBy(F.col("v").asc_nulls_last(), F.col("k").asc_nulls_last())
    want = {r["k"]: r["lane"] for r in bars.withColumn("lane", F.row_number().over(w)).collect()}
    assert got == want
    assert sorted(got.values()) == list(range(1, len(got) + 1))


@SETTINGS
@given(records=RECORDS)
def test_markers_from_the_same_records_have_bars(spark, records):
    rec = _rec(spark, records).withColumn("cat", F.lit("x"))
    bars = subject_bars(rec, "k", "v")
    markers = category_markers(rec, "k", "v", "cat").filter(F.col("k").isNotNull())
    assert orphan_markers(markers, bars, "k").count() == 0


@SETTINGS
@given(records=RECORDS, seed=st.integers(0, 99))
def test_first_per_key_independent_of_row_order(spark, records, seed):
    shuffled = list(records)
    random.Random(seed).shuffle(shuffled)
    a = first_per_key(_rec(spark, records), "k", order=["v"]).collect()
    b = first_per_key(_rec(spark, shuffled).repartition(3), "k", order=["v"]).collect()
    assert sorted(a, key=repr) == sorted(b, key=repr)
