"""Nested values: leaves, change lists, structure; and rare deviations of a column without spread."""

from tracewright.operators import compare as C
from tracewright.operators import profile as P

SCHEMA = "k int, a struct<x: int, y: array<struct<z: string>>>, m map<string, int>"


def test_leaves_of_nested_values(spark):
    df = spark.createDataFrame([(1, (1, [("p",), None]), {"u": 5}), (2, None, {}), (3, (None, []), None)], SCHEMA)
    got = sorted((r.k, r.path, r.value) for r in C.leaves(df, "k", ["a", "m"]).collect())
    assert got == [(1, "a.x", "1"), (1, "a.y[0].z", "p"), (1, "a.y[1]", None), (1, "m.u", "5"), (2, "a", None), (2, "m", "{}"), (3, "a.x", None), (3, "a.y", "[]"), (3, "m", None)]


def test_nested_changes_and_ignored_paths(spark):
    a = spark.createDataFrame([(1, (1, [("p",)]), {"u": 5}), (2, (1, []), {}), (4, None, None)], SCHEMA)
    b = spark.createDataFrame([(1, (2, [("p",), ("q",)]), {"u": 6}), (2, (1, []), {}), (5, None, None)], SCHEMA)
    rows = lambda *ignore: sorted((r.k, r.path, r.before, r.after) for r in C.nested_changes(a, b, "k", ignore).collect())
    assert rows() == [(1, "a.x", "1", "2"), (1, "a.y[1].z", None, "q"), (1, "m.u", "5", "6")]
    assert rows("a.y", "m") == [(1, "a.x", "1", "2")] and rows("a") == [(1, "m.u", "5", "6")]
    assert C.nested_changes(a.limit(0), b, "k").collect() == []


def test_structure_counts_every_value(spark):
    df = spark.createDataFrame([(1, (1, [("p",), None]), {"u": 5}), (2, None, {})], SCHEMA)
    got = {r.kind: tuple(r)[1:] for r in P.structure(df).collect()}
    assert got == {"number": (4, 2, None, 0), "object": (4, 3, None, 0), "array": (1, 2, 2, 1), "string": (1, 4, None, 0), "null": (2, 3, None, 0)}


def test_rare_deviations_without_spread(spark):
    values = lambda rare: spark.createDataFrame([(i, 7.0 if i >= rare else float(i)) for i in range(20)], "k int, v double")
    assert sorted(map(tuple, P.mad_outliers(values(2), ["k"], "v").collect())) == [(0, 0.0, None), (1, 1.0, None)]
    assert P.mad_outliers(values(6), ["k"], "v").collect() == []  # 70 % are not dominant


def test_names_with_dots_are_not_paths(spark):
    one = lambda flat, inner: spark.sql(f"SELECT 1 AS k, {flat} AS `a.b`, named_struct('b', {inner}, 'c d', 5) AS a")
    assert [tuple(r) for r in C.nested_changes(one(1, 2), one(3, 2), "k").collect()] == [(1, '["a.b"]', "1", "3")]
    assert sorted(r["path"] for r in C.leaves(one(1, 2), "k", ["a.b", "a"]).collect()) == ['["a.b"]', "a.b", 'a["c d"]']


def test_a_null_that_is_there_changes(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "y", None)], "k int, s string, t string")
    b = spark.createDataFrame([(1, "v", "x"), (2, None, None), (3, None, "z")], "k int, s string, t string")
    got = {(r["k"], r["path"]): r["status"] for r in C.structural_diff(a, b, "k").collect()}
    assert got == {(1, "s"): "change", (1, "t"): "same", (2, "s"): "change", (2, "t"): "same", (3, "s"): "add", (3, "t"): "add"}
