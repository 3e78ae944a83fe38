import os
import tempfile

import pytest

from conftest import SMOKE_DIR
from tideline.operators.checks import validate_all
from tideline.roles import Roles
from tideline.sources import (
    DatasetError,
    list_datasets,
    load_dataset,
    load_table,
    require_nonempty,
    shape,
    write_report,
    write_result,
)


def test_csv_with_declared_schema_keeps_ids(spark):
    # C25
    d = tempfile.mkdtemp(prefix="tideline-src-")
    with open(os.path.join(d, "ADSL.csv"), "w") as f:
        f.write("USUBJID,SUBJID,AGE,EMPTY\nS-001,001,NA,\nS-002,002,40,\n")
    df = load_dataset(spark, "ADSL", d, schema="USUBJID string, SUBJID string, AGE double, EMPTY string",
                      null_values="NA")
    got = [tuple(r) for r in df.orderBy("USUBJID").collect()]
    assert got == [("S-001", "001", None, None), ("S-002", "002", 40.0, None)]
    assert shape(df) == (2, 4)


def test_unknown_and_missing_datasets(spark):
    with pytest.raises(DatasetError):
        load_dataset(spark, "ADXX", "/nowhere")
    with pytest.raises(DatasetError):
        load_dataset(spark, "ADRS", "/nowhere")
    with pytest.raises(DatasetError):
        require_nonempty(None, "ADSL")
    with pytest.raises(DatasetError):
        require_nonempty(spark.range(0), "ADSL")


def test_catalogue(spark):
    names = [r["name"] for r in list_datasets(spark).collect()]
    assert names == ["ADSL", "ADRS", "ADTTE", "ADTR"]


def test_write_result_and_report(spark):
    out = tempfile.mkdtemp(prefix="tideline-out-")
    orders = load_table(spark, SMOKE_DIR, "orders")
    write_result(orders.select("o_orderkey", "o_orderstatus"), f"{out}/res",
                 partition_by=["o_orderstatus"])
    assert spark.read.parquet(f"{out}/res").count() == orders.count()
    rep = validate_all(orders, Roles("o_orderkey", "o_orderdate", "o_totalprice"))
    write_report(rep, f"{out}/rep")
    write_report(rep, f"{out}/rep")
    assert spark.read.json(f"{out}/rep").count() == 2 * rep.count()


def test_observe_shape_and_register(spark):
    from tideline.sources import observe_shape, register_datasets
    orders = load_table(spark, SMOKE_DIR, "orders")
    df, obs, ncols = observe_shape(orders)
    df.write.format("noop").mode("overwrite").save()
    assert (obs.get["rows"], ncols) == (orders.count(), 6)
    d = tempfile.mkdtemp(prefix="tideline-reg-")
    with open(os.path.join(d, "ADSL.csv"), "w") as f:
        f.write("USUBJID,AGE\nS1,40\n")
    register_datasets(spark, d, ["ADSL"])
    assert spark.sql("SELECT AGE FROM ADSL").first()[0] == 40


def test_parquet_filters_reach_the_scan(spark):
    ev = load_table(spark, SMOKE_DIR, "events").filter("value > 10")
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,10.0)" in plan


def test_csv_nan_is_null(spark):
    d = tempfile.mkdtemp(prefix="tideline-nan-")
    with open(os.path.join(d, "ADRS_ONCO.csv"), "w") as f:
        f.write("USUBJID,EOS\nS1,NaN\nS2,3.5\n")
    df = load_dataset(spark, "ADRS", d, schema="USUBJID string, EOS double")
    assert [r[0] for r in df.orderBy("USUBJID").select("EOS").collect()] == [None, 3.5]
