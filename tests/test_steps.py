import pytest

from conftest import rows
from tideline.plans.steps import StepFailed, apply_steps, guarded_transform
from tideline.roles import Roles


@pytest.fixture
def tables(spark):
    records = spark.createDataFrame([("a", 1, None), ("a", 5, 2.0), ("b", 3, 1.0), ("c", 9, None)],
                                    "USUBJID string, ADY int, EOS double")
    subjects = spark.createDataFrame([("a", "ARM1", 10), ("b", "ARM2", 20), ("b", "ARM9", 30)],
                                     "USUBJID string, TRT01P string, AGE int")
    return records, subjects


def test_apply_steps(tables):
    records, subjects = tables
    steps = [
        {"kind": "merge", "key": "USUBJID", "order": ["AGE"]},
        {"kind": "derive", "name": "DUR", "expr": "ADY * 2"},
        {"kind": "filter", "predicate": "ADY < 9"},
        {"kind": "fill", "values": {"EOS": 0.0}},
        {"kind": "exclude_subjects", "key": "USUBJID", "subjects": ["b"]},
    ]
    res = apply_steps(records, steps, subjects, roles=Roles("USUBJID", "ADY", "DUR"),
                      request="double the study day")
    assert res.ok
    assert rows(res.df, "USUBJID", "ADY", "EOS", "TRT01P", "DUR") == [
        ("a", 1, 0.0, "ARM1", 2), ("a", 5, 2.0, "ARM1", 10)]
    assert res.lineage["derived"] == ["DUR"] and res.lineage["formulas"] == {"DUR": "ADY * 2"}
    assert res.row_counts() == {"before": 4, "after": 2}


def test_apply_steps_refuses_plot_terms(tables):
    records, subjects = tables
    res = apply_steps(records, [], subjects, request="change the chart title")
    assert res.status == "refused" and res.df is records


def test_guarded_transform_failures(tables):
    # C24
    records, _ = tables
    roles = Roles("USUBJID", "ADY", "EOS")
    res = guarded_transform(records, lambda d: d.drop("EOS"), roles)
    assert res.status == "missing_columns" and res.df is records
    res = guarded_transform(records, lambda d: d.select("nope"), roles)
    assert res.status == "error" and res.df is records
    res = guarded_transform(records, lambda d: None, roles)
    assert res.status == "no_output"
    with pytest.raises(StepFailed):
        guarded_transform(records, lambda d: d.select("nope"), roles, strict=True)
    res = guarded_transform(records, lambda d: d.unionByName(d), roles, observe_rows=True)
    res.df.collect()
    assert res.ok and res.row_counts() == {"before": 4, "after": 8}
