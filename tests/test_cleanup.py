"""Suggestions to clean inputs, and what programs change."""

from tracewright.operators import cleanup as C
from tracewright.plans.program import Op


def test_suggestions_and_their_application(spark):
    df = spark.createDataFrame([("1.5", "007", "true", "a;b", "2026-01-02", ("9", "x, y")), ("", "12", "FALSE", "c; d;e", "2026-01-03", ("10", "z, w")), (None, "13", None, "f;g", "2026-01-04", ("11", "q, r"))], "price string, zip string, ok string, tags string, day string, m struct<weight: string, name: string>")
    found = C.suggestions(df)
    assert [(s.kind, s.path, s.values) for s in found] == [("coerce-number", "price", 1), ("coerce-boolean", "ok", 2), ("split-array", "tags", 3), ("coerce-number", "m.weight", 3)]
    rows = [r.asDict(recursive=True) for r in C.cleaned(df, found).collect()]
    assert rows[0] == {"price": 1.5, "zip": "007", "ok": True, "tags": ["a", "b"], "day": "2026-01-02", "m": {"weight": 9.0, "name": "x, y"}}
    assert rows[1]["price"] is None and rows[1]["ok"] is False and rows[1]["tags"] == ["c", "d", "e"] and rows[2]["ok"] is None
    assert C.suggestions(df.where("false")) == [] and C.suggestions(spark.range(3)) == []


def test_ledger(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "B", 3.0)], "id long, s string, v double")
    got = {r["target"]: r for r in C.ledger(df, [Op("stringCase", "t", {"source": "s", "mode": "lower"}), Op("numericBinary", "sum", {"left": "id", "right": "v", "mode": "add"}), Op("set", "same", {"source": "s"})], "id").collect()}
    assert (got["t"]["effect"], got["t"]["changed"], got["t"]["example_key"], got["t"]["before"], got["t"]["after"]) == ("changed", 1, "2", '"B"', '"b"')
    assert got["sum"]["effect"] == "computed" and got["same"]["effect"] == "moved" and got["same"]["example_key"] is None
