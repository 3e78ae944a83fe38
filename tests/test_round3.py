"""Staged transforms (E1), merge contract (J2), lazy lanes (W2) and what followed in the same round."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE_DIR, rows
from tideline.functions import day_diff
from tideline.operators.checks import transform_report, validation_report
from tideline.operators.merge import merge_contract, merge_subjects
from tideline.operators.profile import SKETCH_BOUND, column_sketches, distinct_values, merged_profile, sample_values, smallest_distinct
from tideline.operators.skew import repeat_rows
from tideline.operators.textjobs import parse_status, screen_term_table, screen_terms
from tideline.operators.timeline import assemble_layers, bar_conflicts, category_markers, lane_order, record_layers, subject_bars
from tideline.plans.bars import record_conflicts
from tideline.plans.catalog import QUERIES
from tideline.plans.steps import StepFailed, apply_steps, staged_transform
from tideline.roles import Roles
from tideline.sources import append_run, read_runs, write_report
from tideline.sources.datasets import DatasetError
from tideline.sources.staging import shared_dir, stage_table
from tideline.sources.typed_csv import load_typed_dataset, read_typed_csv


def staged_folders(spark):
    top = shared_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(top) if f.startswith("staged-")} if os.path.isdir(top) else set()


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


@pytest.fixture
def records(spark):
    return spark.createDataFrame([("a", 1, "3"), ("a", 5, "4"), ("b", 3, "x"), ("c", 9, None)], "USUBJID string, ADY int, AVAL string")


ROLES = Roles("USUBJID", "ADY", "AVAL")


def test_a_transform_that_fails_on_one_row_keeps_the_original(spark, records):
    before = staged_folders(spark)
    res = staged_transform(records, lambda d: d.withColumn("AVAL", F.col("AVAL").cast("int")), ROLES)
    assert (res.status, res.message, res.df) == ("run_error", "CAST_INVALID_INPUT", records) and not res.ok
    assert staged_folders(spark) == before  # nothing half-written stays
    with pytest.raises(StepFailed, match="run_error"):
        staged_transform(records, lambda d: d.withColumn("AVAL", F.col("AVAL").cast("int")), ROLES, strict=True)


def test_a_sound_transform_is_committed_and_not_computed_again(spark, records):
    calls = spark.sparkContext.accumulator(0)

    def once(batches):
        calls.add(1)
        yield from batches

    res = staged_transform(records.coalesce(1), lambda d: d.mapInArrow(once, d.schema), ROLES, rows="same")
    assert res.status == "committed" and res.ok
    assert rows(res.df) == rows(records) == rows(res.df)
    assert calls.value == 1
    res.staged.drop()
    assert os.path.basename(res.staged.path) not in staged_folders(spark)


@pytest.mark.parametrize("fn,kw,message", [
    (lambda d: d.filter("ADY < 9"), {"rows": "same"}, "rows: 4 before, 3 after"),
    (lambda d: d.unionByName(d), {"rows": "no_more"}, "rows: 4 before, 8 after"),
    (lambda d: d.withColumn("DUR", F.lit(None).cast("int")), {"filled": ["DUR"]}, "columns without a value: ['DUR']"),
    (lambda d: d.withColumn("ADY", F.col("ADY").cast("long")), {"types": {"ADY": "int"}}, "column types differ: {'ADY': 'bigint'}"),
    (lambda d: d, {"types": {"DUR": "int"}}, "column types differ: {'DUR': None}"),
])
def test_a_broken_contract_keeps_the_original(spark, records, fn, kw, message):
    before = staged_folders(spark)
    res = staged_transform(records, fn, ROLES, **kw)
    assert (res.status, res.message, res.df) == ("contract", message, records)
    assert staged_folders(spark) == before


def test_plan_errors_lost_roles_and_empty_tables(records):
    assert staged_transform(records, lambda d: d.select("nope"), ROLES).status == "error"
    assert staged_transform(records, lambda d: None, ROLES).status == "no_output"
    assert staged_transform(records, lambda d: d.drop("AVAL"), ROLES).status == "missing_columns"
    none = staged_transform(records.filter("false"), lambda d: d, ROLES, rows="same")
    assert none.status == "committed" and none.df.count() == 0
    with pytest.raises(ValueError):
        staged_transform(records, lambda d: d, rows="fewer")


def test_steps_can_be_staged(records, spark):
    subjects = spark.createDataFrame([("a", "A"), ("b", "B")], "USUBJID string, ARM string")
    steps = [{"kind": "merge"}, {"kind": "derive", "name": "DUR", "expr": "cast(AVAL as int)"}]
    res = apply_steps(records, steps, subjects, stage=True, rows="same")
    assert res.status == "run_error" and res.df is records
    res = apply_steps(records, [*steps[:1], {"kind": "filter", "predicate": "ARM is not null"}], subjects, stage=True)
    assert res.status == "committed" and rows(res.df, "USUBJID", "ARM") == [("a", "A"), ("a", "A"), ("b", "B")]


def test_merge_contract_names_the_arms_that_change(spark):
    recs = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", "B"), (None, "B"), ("z", None)], "k string, arm string")
    subj = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), (None, 7)], "k string, v int")
    cols = ("arm", "rows_before", "rows_after", "n_matched", "n_subjects", "n_changed", "kept")
    assert rows(merge_contract(recs, subj, "k", by="arm"), *cols) == sorted(
        [("A", 2, 2, 2, 1, 0, True), ("B", 2, 2, 1, 2, 0, True), (None, 1, 1, 0, 1, 0, True)], key=repr)
    assert rows(merge_contract(recs, subj, "k", by="arm", dedup=False), *cols) == sorted(
        [("A", 2, 2, 2, 1, 0, True), ("B", 2, 3, 2, 2, 1, False), (None, 1, 1, 0, 1, 0, True)], key=repr)
    assert rows(merge_contract(recs, subj, "k", null_keys="match"), "rows_after", "n_matched", "kept") == [(5, 4, True)]
    assert rows(merge_contract(recs.limit(0), subj, "k", by="arm")) == []
    assert rows(merge_contract(recs.limit(0), subj, "k")) == [(0, 0, 0, 0, 0, True)]


def test_merge_contract_computes_the_merge(spark):
    recs = spark.range(1000).select((F.col("id") % 7).alias("k"))
    subj = spark.range(7).withColumnRenamed("id", "k").withColumn("v", F.rand())
    df = merge_contract(recs, subj, "k")
    df.collect()
    assert "Join" in df._jdf.queryExecution().executedPlan().toString()


def test_building_lanes_starts_no_job_and_leaves_no_files(spark):
    bars = spark.range(100).select(F.col("id").alias("s"), (F.col("id") % 10).alias("bar"))
    top = shared_dir(spark).removeprefix("file:")
    before, files = jobs(spark), set(os.listdir(top))
    out = lane_order(bars, "s", "bar")
    assert jobs(spark) == before
    assert rows(out, "lane") == [(i,) for i in sorted(range(1, 101), key=lambda i: repr((i,)))]
    assert set(os.listdir(top)) == files


@pytest.mark.parametrize("kind", ["string", "long", "date", "binary", "decimal(20,3)"])
def test_lanes_with_one_shared_bar_length_and_nulls(spark, kind):
    def subject(i):
        key = F.concat(F.lit("s"), F.lpad(i.cast("string"), 5, "0"))
        return {"string": key, "binary": key.cast("binary"), "date": F.date_add(F.lit("2020-01-01").cast("date"), i.cast("int"))}.get(kind, i.cast(kind))

    i = F.col("id")
    bar = F.when(i % 11 == 0, F.lit(None)).when(i % 3 == 0, F.lit(5)).otherwise(i % 400).cast("long")
    df = spark.range(3000).select(subject(i).alias("s"), bar.alias("bar"), F.lit("x").alias("_range"))
    df = df.union(df.limit(1).withColumn("s", F.lit(None).cast(df.schema["s"].dataType)))
    got = [r["s"] for r in lane_order(df.drop("_range"), "s", "bar").orderBy("lane").collect()]
    want = [r["s"] for r in df.orderBy(F.col("bar").asc_nulls_last(), F.col("s").asc_nulls_last()).collect()]
    assert got == want


def test_no_lane_range_holds_most_subjects(spark):
    """Two thirds share a bar length; the subjects' split points divide them."""
    df = spark.range(30000).select(F.col("id").alias("s"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("bar"))
    out = lane_order(df, "s", "bar", num_partitions=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan and "_part" in plan
    out.collect()
    assert out.selectExpr("count(distinct lane)", "max(lane)").first()[:] == (30000, 30000)


def test_lanes_of_an_empty_table(spark):
    assert lane_order(spark.createDataFrame([], "s string, bar long"), "s", "bar").collect() == []
    assert rows(lane_order(spark.createDataFrame([("b", None), ("a", None)], "s string, bar long"), "s", "bar"), "s", "lane") == [("a", 1), ("b", 2)]


def test_staged_tables_are_copies(spark):
    src = spark.range(3).toDF("x")
    staged = stage_table(src, "copy")
    assert rows(staged.df) == [(0,), (1,), (2,)] and staged.df.dtypes == src.dtypes
    staged.drop()


def plan_of(df):
    """The plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


# Bounded distinct samples (A6, A7) and stored sketches (A8) ---------------------------------------

def test_smallest_distinct_of_many_kinds(spark):
    df = spark.range(5000).select(
        (F.col("id") % 977).alias("few"), F.col("id").alias("key"), F.lit(None).cast("int").alias("none"),
        F.concat(F.lit("é"), F.col("id") % 313).alias("text"), (F.col("id") % 2 == 0).alias("flag"),
        F.when(F.col("id") == 9, float("nan")).otherwise(-F.col("id").cast("double")).alias("number"),
        F.array(F.col("id") % 3).alias("list"), F.lit("one").alias("a.b"))
    got = smallest_distinct(df, df.columns, 4).select(F.col("values")[0].alias("v")).select("v.*").first()
    want = [sorted({r[c] for r in df.select(f"`{c}`").collect() if r[c] is not None}, key=lambda v: (v != v, v))[:4]
            for c in ("few", "key", "none", "text", "flag", "number")]
    assert [list(x) for x in got[:6]] == want
    assert list(got[6]) == ["[0]", "[1]", "[2]"] and list(got[7]) == ["one"]
    assert [tuple(r) for r in sample_values(df.select("text"), k=2).collect()] == [("text", 1, "é0"), ("text", 2, "é1")]
    assert sample_values(df.limit(0)).collect() == []


def test_samples_shuffle_no_distinct_values(spark):
    df = sample_values(spark.range(20000).select(F.col("id").cast("string").alias("a"), F.col("id").alias("b")), k=3)
    plan = plan_of(df)
    assert plan.count("Exchange SinglePartition") == 2 and "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_distinct_preview_counts_once(spark):
    df = distinct_values(spark.range(3000).select((F.col("id") % 100).alias("v")), "v")
    assert rows(df) == [("v", 100, ", ".join(map(str, range(30))) + "...")]
    assert rows(distinct_values(spark.createDataFrame([], "v string"), "v")) == [("v", 0, "")]


def test_stored_sketches_merge_to_a_profile(spark):
    df = spark.range(20000).select((F.col("id") % 4).cast("int").alias("part"), (F.col("id") % 6000).alias("k"),
                                   F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("x"))
    whole = stage_table(column_sketches(df.filter("part < 3"), by="part"), "sketches")
    grown = whole.df.unionAll(column_sketches(df.filter("part = 3"), by="part"))  # only the new part is read again
    got = {r["column_name"]: r for r in merged_profile(grown).collect()}
    assert (got["k"]["n_rows"], got["k"]["non_null"], got["x"]["non_null"]) == (20000, 20000, 10000)
    assert abs(got["k"]["n_distinct"] - 6000) <= SKETCH_BOUND * 6000 and abs(got["x"]["n_distinct"] - 10000) <= SKETCH_BOUND * 10000
    whole.staged = whole.drop()
    assert rows(merged_profile(column_sketches(df.filter("false"))), "column_name", "n_rows", "n_distinct") == [
        ("k", 0, 0), ("part", 0, 0), ("x", 0, 0)]


# Sinks (S5, S6) -----------------------------------------------------------------------------------

@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_a_retried_report_is_there_once(spark, tmp_path, fmt):
    path = str(tmp_path / "store")
    report = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    for run in ("2024-01-01", "007", "2024-01-01"):
        write_report(report, path, fmt, run_id=run)
    back = read_runs(spark, path, report.schema, fmt)
    assert rows(back, "run_id", "n", "t") == sorted([(r, *x) for r in ("2024-01-01", "007") for x in ((1, "a"), (2, None))], key=repr)
    append_run(report.limit(1), path, "007", fmt)  # a corrected run replaces its own rows only
    assert read_runs(spark, path, report.schema, fmt).groupBy("run_id").count().orderBy("run_id").collect()[0][:] == ("007", 1)
    append_run(report.limit(0), path, "empty", fmt)
    assert read_runs(spark, path, report.schema, fmt).count() == 3
    with pytest.raises(ValueError):
        append_run(report, path, "")


# One pass (U4, V9) and below the merge (G7) -------------------------------------------------------

@pytest.fixture
def merged(spark):
    return spark.createDataFrame([("a", 3, "x"), ("a", 3, "x"), ("a", 1, None), ("b", None, "y"), ("c", 5, "z"), ("c", None, "z"), (None, 2, "x")],
                                 "s string, d int, cat string")


def test_record_layers_equal_assembled_layers(merged):
    want = assemble_layers(subject_bars(merged, "s", "d"), "s", "d", category_markers(merged, "s", "d", "cat"))
    got = record_layers(merged, "s", "d", "cat")
    assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(record_layers(merged.limit(0), "s", "d", "cat")) == []


def test_layers_scan_each_table_once(spark):
    plan = plan_of(QUERIES["layers"](spark, SMOKE_DIR))
    assert plan.count("lineitem.parquet") == 1 and plan.count("orders.parquet") == 1


def test_copies_are_written_in_chunks(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", None), ("d", 1)], "k string, n int")
    out = repeat_rows(df, "n", chunk=3)
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {"a": 10, "d": 1} and out.columns == ["k"]


def test_a_report_runs_one_job(spark, merged):
    roles = type("R", (), {"required": lambda self: ["s", "d"], "subject": "s", "x": "d", "bar": "d"})()
    spark.sparkContext.setJobGroup("report", "report")
    try:
        got = transform_report(merged, lambda d: d.filter("d > 1"), roles, order=["d", "s"], lineage={"request": "r"})
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("report")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = validation_report(merged.filter("d > 1"), roles, original=merged, order=["d", "s"], lineage={"request": "r"})
    assert got.columns == want.columns and rows(got) == rows(want)
    empty = transform_report(merged, lambda d: d.filter("false"), roles, order=["d"]).first()
    assert (empty["original_shape"]["rows"], empty["processed_shape"]["rows"], list(empty["first_rows"])) == (7, 0, [])


def test_conflicts_below_the_merge_equal_conflicts_above(spark):
    recs = spark.createDataFrame([("a", "2024-01-05"), ("a", "2024-01-05"), ("a", "2024-01-09"), ("b", "2024-01-02"), ("b", "2024-01-02"),
                                  ("c", None), ("c", "2024-01-03"), ("z", "2024-01-01"), ("z", "2024-02-01"), (None, "2024-01-01")], "k string, t string")
    recs = recs.withColumn("t", F.to_timestamp("t"))
    subj = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01"), ("c", "2024-01-01"), ("a", "2024-01-04")], "k string, r string")
    subj = subj.withColumn("r", F.to_timestamp("r"))
    got = record_conflicts(recs, subj, ("k", "k"), "r", "t")
    above = merge_subjects(recs, subj, "k").withColumn("day", day_diff("r", "t", inclusive=True))
    assert rows(got) == rows(bar_conflicts(above, "k", "day")) == [("a", 5, 9, 2)]


# X1 with a table of terms, X3 ---------------------------------------------------------------------

def test_a_term_table_finds_what_contains_finds(spark):
    terms = ["aria", "riadne", "Ariadne's thread", "é", "thé", "thread", "readily available", "x", "", None, "aaaa", "ab", "abc", "straße", "no such term"]
    texts = [(1, "Ariadne's threads"), (2, "thé vert, THÉ noir"), (3, None), (4, ""), (5, "a" * 50), (6, "readily availabl"), (7, "xabcx straSSE STRAßE"),
             (8, "the " * 3000 + "readily available"), (None, "thread"), (None, "aria"), (1, "x")]
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in texts], "id int, text string, _term string, _at int")
    table = spark.createDataFrame([(t,) for t in terms], "t string")
    got = {r["id"]: list(r["issues"]) for r in screen_term_table(df, ["id"], "text", table, "t").collect()}
    want: dict = {}
    for i, t in texts:
        want.setdefault(i, set()).update(x.lower() for x in terms if x and t and x.lower() in t.lower())
    assert got == {i: sorted(v) for i, v in want.items()}
    listed = screen_terms(df.filter("id = 8"), "text", ["thread", "readily available"]).first()["issues"]
    assert set(listed) < set(got[8]) and all(r["valid"] == (not r["issues"]) for r in screen_term_table(df, ["id"], "text", table, "t").collect())


def test_an_empty_term_table_and_no_texts(spark):
    df = spark.createDataFrame([(1, "some text")], "id int, text string")
    none = spark.createDataFrame([], "t string")
    assert rows(screen_term_table(df, ["id"], "text", none, "t")) == [(1, [], True)]
    assert rows(screen_term_table(df.limit(0), ["id"], "text", none.unionAll(spark.sql("select 'text'")), "t")) == []


def test_many_random_terms(spark):
    import random

    rng = random.Random(5)
    terms = {"".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))) for _ in range(600)}
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))) for i in range(120)]
    df, table = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "t string")
    got = {r["id"]: list(r["issues"]) for r in screen_term_table(df, ["id"], "text", table, "t").collect()}
    assert got == {i: sorted(t for t in terms if t in x) for i, x in texts}


@pytest.mark.parametrize("text,want", [
    ("PROTECTED_TRACE: bar\nmore", ("protected_trace", "bar")),
    ("\n \r\n ## already_overlaid\r\n\r\n # second line \nthird", ("already_overlaid", "second line")),
    ("WRONG_CATEGORY", ("wrong_category", "")), ("WRONG_CATEGORY: \n\n  ", ("wrong_category", "")),
    ("hello\nWRONG_CATEGORY: x", (None, None)), ("", (None, None)), (None, (None, None)), ("#", (None, None)),
])
def test_status_lines(spark, text, want):
    df = parse_status(spark.createDataFrame([(text,)], "t string"), "t")
    assert df.columns == ["t", "status", "detail"] and tuple(df.first())[1:] == want


# S1 typed CSV -------------------------------------------------------------------------------------

def test_typed_csv_keeps_identifiers_and_bad_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,n,x,day,note,void,mixed\n007,1,1.5,2024-01-31,"a, ""b""",,1\n008,-2,2,2024-02-01,c,,y\n'
                    "009,3,4,2024-02-02,too,,many,fields\n010,4\n\n")
    t = read_typed_csv(spark, str(path))
    assert t.types == {"id": "string", "n": "bigint", "x": "double", "day": "timestamp", "note": "string", "void": "string", "mixed": "string"}
    t = read_typed_csv(spark, str(path), types={"n": "int", "mixed": "int"})
    assert rows(t.df, "id", "n", "x", "mixed")[:1] == [("007", 1, 1.5, 1)] and t.df.count() == 1
    assert sorted((r["column_name"] or "", r["value"] or "", r["reason"]) for r in t.rejects.collect()) == [
        ("", "", "fields"), ("", "", "fields"), ("mixed", "y", "int")]
    assert t.rejects.filter("reason = 'fields'").count() == 2 and t.rejects.count() == 3
    t.staged.drop()


def test_typed_csv_with_line_breaks_in_values(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('id,note\n01,"two\nlines"\n02,one\n')
    t = read_typed_csv(spark, str(path), multi_line=True)
    assert rows(t.df) == [("01", "two\nlines"), ("02", "one")] and t.rejects.count() == 0


def test_typed_csv_rows_are_all_accounted_for(spark, tmp_path):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("id"),
                                  F.when(F.col("id") % 10 == 0, "n/a").otherwise(F.col("id").cast("string")).alias("n"))
    df.repartition(4).write.option("header", True).csv(str(tmp_path / "b"))
    t = read_typed_csv(spark, str(tmp_path / "b"), types={"n": "bigint"}, text=["id"])
    assert (t.df.count(), t.rejects.count()) == (900, 100)
    assert t.df.agg(F.min("id"), F.sum("n")).first()[:] == ("00001", sum(i for i in range(1000) if i % 10))
    t = read_typed_csv(spark, str(tmp_path / "b"), null_values="n/a")
    assert t.types["n"] == "bigint" and t.df.filter("n is null").count() == 100


def test_named_datasets_are_read_typed(spark, tmp_path):
    (tmp_path / "ADSL.csv").write_text("USUBJID,AGE,TRTSDT\n001,64,2024-01-31\n002,,2024-02-01\n")
    t = load_typed_dataset(spark, "ADSL", str(tmp_path))
    assert t.types == {"USUBJID": "string", "AGE": "bigint", "TRTSDT": "timestamp"} and rows(t.df, "USUBJID", "AGE") == [("001", 64), ("002", None)]
    for name in ("ADRS", "NOPE"):
        with pytest.raises(DatasetError):
            load_typed_dataset(spark, name, str(tmp_path))


def test_typed_csv_without_rows_and_unknown_columns(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("a,b\n")
    t = read_typed_csv(spark, str(path))
    assert (t.types, t.df.count(), t.rejects.count()) == ({"a": "string", "b": "string"}, 0, 0)
    with pytest.raises(DatasetError):
        read_typed_csv(spark, str(path), types={"c": "int"})
