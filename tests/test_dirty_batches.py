"""Inference on batches with bad rows, and contracts whose invariants notice or miss a change."""

import pytest

from tracewright.operators import contract as K
from tracewright.operators import infer as I
from tracewright.plans import export
from tracewright.plans.program import Op


def test_a_corrupt_row_does_not_decide(spark):
    rows = [(i, i * 3, i * 3 + 11 if i % 20 else -5, "x" if i % 20 else "?") for i in range(200)]
    pairs = spark.createDataFrame(rows, "id long, a long, b long, c string")
    found = {r.target: r for r in I.infer(pairs, ["id", "a"], {"b": "b", "c": "c"})}
    assert found["b"].op == Op("numericTransform", "b", {"source": "a", "mode": "add", "value": 11}) and found["b"].status == "dominant" and found["b"].matches == 190
    assert found["c"].op == Op("constant", "c", {"value": "x"}) and found["c"].status == "dominant"
    first = [{"a": 1, "_out": 999}] + [{"a": i, "_out": i + 11} for i in range(2, 40)]
    assert Op("numericTransform", "b", {"source": "a", "mode": "add", "value": 11}) in I.proposals(first, ["a"], "b")


def test_mutations_run_the_invariants(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (3, "a", 0.0)], "id long, s string, v double")
    program = [Op("set", "s", {"source": "s"}), Op("set", "v", {"source": "v"})]
    count = lambda c: {(r["mutation"], r["target"]): (r["rows"], r["changed"], r["detected"]) for r in K.mutations(c, df).collect()}
    blind = count(K.Contract(program, key=["id"]))
    assert all(detected == 0 for _, _, detected in blind.values()) and blind["unit", "v"] == (3, 2, 0)
    seen = count(K.Contract(program, invariants=[{"kind": "allowed_values", "path": "s", "values": ["a", "b"]}, {"kind": "key_unique"}, {"kind": "key_set_preserved"}], key=["id"]))
    assert seen["case", "s"] == (3, 3, 3) and seen["remove", "v"] == (3, 3, 0)
    assert seen["drop_row", ""][2] == 1 and seen["duplicate_key", ""][2] == 1


def test_unknown_output_fields_are_refused():
    program = [Op("set", "s", {"source": "s"})]
    assert K.Contract(program, invariants=[{"kind": "no_unknown_output_fields", "fields": ["s"]}]).problems() == []
    assert K.Contract(program, invariants=[{"kind": "no_unknown_output_fields", "fields": ["t"]}]).problems() == ["unknown output field s"]


def test_sql_export_refuses_what_it_cannot_say():
    with pytest.raises(ValueError, match="dateFormat"):
        export.spark_sql([Op("dateFormat", "d", {"source": "s", "mode": "iso"})], "t")
