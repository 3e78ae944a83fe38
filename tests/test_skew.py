"""Hot subjects: one lazy plan that equals a plain join, and that adaptive
execution splits where a key holds a third of all rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE_DIR, rows
from tideline.operators.derive import exclude_subjects, keep_subjects, per_subject
from tideline.operators.merge import check_row_count, merge_subjects, merge_with_counts, orphan_markers
from tideline.operators.skew import join_one_per_key
from tideline.operators.textjobs import conversation_log
from tideline.plans.catalog import QUERIES

SPLIT_SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
}


@pytest.fixture
def small_splits(spark):
    """Sizes at which the split shows on test tables."""
    old = {k: spark.conf.get(k, None) for k in SPLIT_SMALL}
    for k, v in SPLIT_SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def skewed(spark):
    # key 7 holds a third of all rows; some keys are NULL
    rec = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(7))
        .when(F.col("id") % 101 == 0, F.lit(None))
        .otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("v"))
    sub = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 4).cast("string").alias("arm"))
    return rec, sub


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_split_join_equals_plain_join(skewed, how, null_safe):
    rec, sub = skewed
    one = sub.withColumnRenamed("k", "sk")
    split = join_one_per_key(rec, one, "k", "sk", how, null_safe=null_safe)
    plain = join_one_per_key(rec, one, "k", "sk", how, null_safe=null_safe, split_hot=False)
    assert split.columns == plain.columns
    assert rows(split) == rows(plain)


@pytest.mark.parametrize("kinds", ["int long", "long double", "decimal(12,2) int", "string int", "date timestamp_ntz"])
def test_keys_of_two_types_meet_as_in_a_plain_join(spark, kinds):
    a, b = kinds.split()
    text = ["2020-01-01", "2020-01-02"] if a == "date" else ["1", "2"]
    left = spark.createDataFrame([(t,) for t in text], "k string").select(F.col("k").cast(a))
    right = spark.createDataFrame([(text[1],)], "sk string").select(F.col("sk").cast(b))
    got = join_one_per_key(left, right, "k", "sk", "inner")
    assert got.count() == left.join(right, left.k == right.sk).count() == 1


def records(spark, kind):
    n, hot = 60_000, F.col("id") % 3 == 0
    key = F.when(hot, F.lit(None) if kind == "null third" else F.lit(7)).otherwise(F.col("id") % 3000)
    text = F.lit("same") if kind == "equal rows" else F.sha2(F.col("id").cast("string"), 256)
    return n, spark.range(0, n, 1, 12).select(key.alias("k"), text.alias("text"))


@pytest.mark.parametrize("kind", ["key and text", "equal rows", "null third"])
def test_no_task_holds_a_third_of_all_rows(spark, small_splits, kind):
    n, rec = records(spark, kind)
    # an aggregated side: already partitioned on the key, so a plain join cannot be split
    sub = spark.range(9000).groupBy((F.col("id") % 3000).alias("k")).agg(F.max("id").cast("string").alias("arm"))
    largest = {}
    for split in (False, True):
        out = merge_subjects(rec, sub, "k", split_hot=split).withColumn("p", F.spark_partition_id())
        largest[split] = Counter(r["p"] for r in out.collect()).most_common(1)[0][1]
    assert largest[False] >= n / 3
    assert largest[True] < n / 5  # the 20,000 rows of the hot key lie in several tasks


def test_building_runs_no_job(spark, skewed):
    rec, sub = skewed
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "no job while a plan is built")
    try:
        merge_subjects(rec, sub, "k")
        per_subject(rec, "k", {"mx": F.max("v")})
        keep_subjects(rec, sub, "k")
        orphan_markers(rec, sub, "k")
        assert not tracker.getJobIdsForGroup("build-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_counts_are_filled_by_the_merge_itself(spark, skewed):
    rec, sub = skewed
    merged, before, after = merge_with_counts(rec, sub, "k")
    merged.write.format("noop").mode("overwrite").save()
    assert before.get["rows"] == 3000
    assert check_row_count(before, after) == 3000


def test_operators_on_skewed_tables(spark, skewed):
    rec, sub = skewed
    plain = rows(merge_subjects(rec, sub, "k", split_hot=False))
    assert rows(merge_subjects(rec, sub, "k")) == plain
    known = {r["k"] for r in sub.collect()}
    data = [tuple(r) for r in rec.collect()]
    assert rows(keep_subjects(rec, sub, "k")) == sorted([r for r in data if r[0] in known], key=repr)
    gone = sorted([r for r in data if r[0] not in known], key=repr)
    assert rows(exclude_subjects(rec, sub, "k")) == rows(orphan_markers(rec, sub, "k")) == gone
    conv = rec.select(F.col("k").alias("conv_id"), F.col("v").alias("turn"), F.lit("user").alias("role"),
                      F.col("v").cast("string").alias("text"))
    sizes = Counter(r[0] for r in data)
    assert all(r["n_messages"] == sizes[r["conv_id"]] for r in conversation_log(conv).collect())


def test_merge_reads_only_what_is_used(skewed):
    rec, sub = skewed
    rec = rec.withColumn("wide", F.repeat(F.lit("x"), 10))
    merged = merge_subjects(rec, sub, "k").select("k", "arm")
    assert "wide" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_hot_query_takes_the_split_route(spark, small_splits):
    df = QUERIES["hot_merge"](spark, SMOKE_DIR)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan
