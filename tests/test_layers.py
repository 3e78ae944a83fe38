from conftest import rows
from tideline.operators.layers import check_edit_contract, layer_changes


def _layers(spark, names):
    return spark.createDataFrame([("p", n) for n in names], "plot_id string, layer string")


def test_edit_contract(spark):
    # C17
    before = _layers(spark, ["a", "b"])
    cases = {"abc": (True, False), "a": (False, True), "ac": (False, False)}
    for after, (add_ok, remove_ok) in cases.items():
        changes = layer_changes(before, _layers(spark, list(after)))
        r = check_edit_contract(changes).first()
        assert (r["add_ok"], r["remove_ok"]) == (add_ok, remove_ok), after
    r = check_edit_contract(layer_changes(_layers(spark, ["a", "b", "c"]), before),
                            mode="remove_overlay").first()
    assert r["ok"] is True and r["n_removed"] == 1


def test_layer_changes_status(spark):
    got = rows(layer_changes(_layers(spark, ["a", "b"]), _layers(spark, ["a", "c"])))
    assert got == [("p", "a", "kept"), ("p", "b", "removed"), ("p", "c", "added")]
