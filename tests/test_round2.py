"""Exact days, failing transforms, restart of the sink and plain sessions; audits, edits and blocks."""

import datetime as dt
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from tideline.functions.dates import day_diff
from tideline.operators.profile import sample_values
from tideline.plans.steps import guarded_transform
from tideline.session import build_session
from tideline.streaming import start_marker_sink


def test_day_diff_is_exact_over_long_spans(spark):
    day = dt.timedelta(days=1)
    pairs = [(dt.datetime(1, 1, 1), dt.datetime(2019, 12, 31, 23, 59, 59, 999999)),
             (dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999)),
             (dt.datetime(9999, 12, 31), dt.datetime(1, 1, 1, 0, 0, 0, 1))]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(day_diff("a", "b")).collect()] == [(b - a) // day for a, b in pairs]


def test_any_exception_keeps_the_original(spark):
    df = spark.range(3)
    for error in (IndexError, ZeroDivisionError, RuntimeError):
        def broken(_, error=error):
            raise error("no")

        out = guarded_transform(df, broken)
        assert out.df is df and out.status == "error"


def test_sink_needs_a_stable_checkpoint(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        start_marker_sink(stream, tempfile.mkdtemp())


_RUN = """
import sys
from pyspark.sql import SparkSession
from tideline.streaming import start_marker_sink
root = sys.argv[1]
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", root + "/shared").getOrCreate())
start = int(sys.argv[2])
spark.range(start, start + 100, 1, 2).write.mode("append").parquet(root + "/in")
q = start_marker_sink(spark.readStream.schema("id long").parquet(root + "/in"), root + "/out", trigger_once=True, query_name="m")
q.awaitTermination(120)
print("ROWS", spark.read.parquet(root + "/out").distinct().count())
"""


def test_restart_in_a_second_session_keeps_every_row():
    root, repo = tempfile.mkdtemp(prefix="tideline-restart-"), __file__.rsplit("/tests/", 1)[0]
    for start, want in ((0, 100), (100, 200)):
        said = subprocess.run([sys.executable, "-c", _RUN, root, str(start)], cwd=repo, capture_output=True, text=True, timeout=200)
        assert f"ROWS {want}" in said.stdout, said.stderr[-1500:]


def test_session_sets_only_what_is_asked(monkeypatch):
    from pyspark.sql import SparkSession

    seen = {}

    class Stop(Exception):
        pass

    class Builder:
        def appName(self, name):
            return self

        def master(self, value):
            seen["master"] = value
            return self

        def config(self, key, value):
            seen[key] = value
            return self

        def getOrCreate(self):
            raise Stop

    monkeypatch.setattr(SparkSession, "builder", Builder())
    with pytest.raises(Stop):
        build_session()
    assert not {"master", "spark.sql.shuffle.partitions", "spark.driver.memory"} & set(seen)


def test_sample_values_takes_every_column(spark):
    df = spark.range(5).select(*[F.col("id").alias(f"c{i}") for i in range(11)])
    assert sample_values(df).select("column_name").distinct().count() == 11


def test_intent_runs_each_pattern_once(spark):
    from tideline.operators.textjobs import classify_intent

    df = spark.createDataFrame([("remove the line",), ("add a marker",), ("add and remove",), (None,)], "text string")
    out = classify_intent(df, "text")
    assert [r["intent"] for r in out.collect()] == ["remove", "add", "both", "none"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2


def test_sample_values_are_the_smallest(spark):
    df = spark.createDataFrame([(10, "b", None), (9, "a", None), (9, "a", None), (None, "c", None)], "n int, s string, e string")
    got = [tuple(r) for r in sample_values(df, k=3).orderBy("column_name", "rank").collect()]
    assert got == [("n", 1, "9"), ("n", 2, "10"), ("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c")]
    assert sample_values(df.limit(0)).count() == 0


def test_an_edit_must_keep_protected_layers(spark):
    from tideline.operators.layers import check_edit_contract, layer_changes

    schema = "plot_id string, layer string"
    before = spark.createDataFrame([("a", "bar"), ("a", "x"), ("b", "bar"), ("b", "x"), ("c", "bar")], schema)
    after = spark.createDataFrame([("a", "x"), ("b", "bar"), ("c", "bar"), ("c", "y"), ("c", "z")], schema)
    cats = spark.createDataFrame([(p, "remove_overlay") for p in "ab"] + [("c", "add_overlay")], "plot_id string, category string")
    out = check_edit_contract(layer_changes(before, after), requests=cats, protected=["bar"])
    got = {r["plot_id"]: (r["added"], r["removed"], r["lost_protected"], r["ok"]) for r in out.collect()}
    assert got == {"a": ([], ["bar"], True, False), "b": ([], ["x"], False, True), "c": (["y", "z"], [], False, False)}


def test_audit_of_categories_and_empty_catalogues(spark):
    from tideline.operators.textjobs import audit_references, audit_verdicts

    df = spark.createDataFrame([(1, 'df["zz"]', "add_overlay"), (2, 'df["zz"]', "title"), (3, 'df["AGE"]', "add_overlay")],
                               "id int, text string, category string")
    names = spark.createDataFrame([("AGE",), (None,)], "name string")
    out = audit_verdicts(df, ["id"], "text", names, category="category")
    assert {r["id"]: (r["unknown"], r["ok"]) for r in out.collect()} == {1: (["zz"], False), 2: ([], True), 3: ([], True)}
    assert audit_references(df, ["id"], "text", names.limit(0)).count() == 0


def test_text_without_a_block_is_stripped(spark):
    from tideline.operators.textjobs import extract_block

    df = spark.createDataFrame([("  x = 1 \n",), (" ```python y",)], "text string")
    assert [r["block"] for r in extract_block(df, "text").collect()] == ["x = 1", "```python y"]


def test_slashed_dates_with_short_parts(spark):
    from tideline.functions import to_timestamp_lenient

    df = spark.createDataFrame([("1/5/2020",), ("01/05/2020",), ("2020/01/05",), ("2020/1/5",), ("1/2",)], "s string")
    got = [r[0] for r in df.select(to_timestamp_lenient("s").cast("date")).collect()]
    assert got == [dt.date(2020, 1, 5)] * 4 + [None]
