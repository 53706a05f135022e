"""Documents of any shape, their schemas, and contracts learned from examples."""

import json

from pyspark.sql import functions as F

from tracewright.operators import contract as K
from tracewright.operators import documents as D

DOCS = [
    (1, '{"a": 1, "b": [{"x": 1, "y": null}, {"x": 2.5, "z z": "q"}], "c": {"d": "q", "e": true}}'),
    (2, '{"a": "s", "b": [], "c": {}}'),
    (3, '[1, 2, [3]]'),
    (4, "no json {"),
    (5, None),
    (6, '"text"'),
    (7, '{"a": 3.0, "rows": [{"k": 1}, {"k": 2}, {"k": 3}], "in": {"deep": [{"p": 1, "q": 2}, {"p": 1, "q": [1]}], "few": [{"p": 1}, 2, 3]}}'),
]


def found(spark, rows=DOCS):
    return D.nodes(spark.createDataFrame(rows, "k int, doc string"), ["k"], "doc")


def plain(value, at="$", path="$"):
    """Every node of a parsed document: at, path, type."""
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "string" if isinstance(value, str) else "integer" if value == int(value) else "number"
    yield at, path, kind
    if isinstance(value, dict):
        for k, v in value.items():
            step = f".{k}" if k.isidentifier() else f'["{k}"]'
            yield from plain(v, at + step, path + step)
    if isinstance(value, list):
        for i, v in enumerate(value):
            yield from plain(v, f"{at}[{i}]", path + "[]")


def test_nodes(spark):
    want = sorted((k, *n) for k, t in DOCS if k not in (4, 5) for n in plain(json.loads(t)))
    assert sorted(tuple(r) for r in found(spark).select("k", "at", "path", "type").collect()) == want


def test_typed_rows_are_documents_too(spark):
    df = spark.sql("SELECT 1 AS k, named_struct('a', array(1, 2), 'b', named_struct('c', CAST(NULL AS STRING))) AS doc")
    assert {(r["at"], r["type"]) for r in D.nodes(df, ["k"], "doc").collect()} == {("$", "object"), ("$.a", "array"), ("$.a[0]", "integer"), ("$.a[1]", "integer"), ("$.b", "object"), ("$.b.c", "null")}


def test_record_sets_are_ranked(spark):
    got = [tuple(r) for r in D.record_sets(found(spark), ["k"]).orderBy("k", "rank").collect()]
    assert got == [(1, "$.b", "$.b", 2, 3, 2 * 100 - 10 + 3, 1), (7, "$.rows", "$.rows", 3, 1, 291, 1), (7, "$.in.deep", "$.in.deep", 2, 2, 182, 2)]
    rows = D.records(found(spark), ["k"], "$.rows").select(F.to_json("record").alias("r")).collect()
    assert sorted(r["r"] for r in rows) == ['{"k":1}', '{"k":2}', '{"k":3}']


def test_leaf_profile(spark):
    got = {r["path"]: tuple(r)[1:] for r in D.leaf_profile(found(spark)).collect()}
    assert got["$.a"] == ("integer,string", 3, 3, 0, 0, 0) and got["$.b[].x"] == ("integer,number", 2, 2, 0, 0, 0) and got["$.b[].y"] == ("null", 2, 1, 1, 0, 0)
    assert got["$.c.d"] == ("string", 2, 1, 0, 0, 0)


def test_schema_is_the_union_of_all(spark):
    s = D.shape(found(spark, [r for r in DOCS if r[0] in (1, 2, 7)])).schema()
    assert s["required"] == ["a"] and s["properties"]["a"] == {"anyOf": [{"type": "integer"}, {"type": "string"}]}
    assert s["properties"]["b"]["items"]["properties"]["x"] == {"type": "number"} and s["properties"]["b"]["items"]["required"] == ["x"]
    assert D.shape(found(spark, [])).schema() == {}


def test_violations(spark):
    df = found(spark, [(1, '{"a": 1, "b": "x"}')])
    wanted = D.shape(df)
    other = found(spark, [(1, '{"a": 1, "b": "y"}'), (2, '{"a": "1"}'), (3, '{"a": 2, "b": null, "c": {"d": 1}}')])
    got = sorted(tuple(r) for r in D.violations(other, ["k"], wanted, closed=True).collect())
    assert got == [(2, "$", "missing b"), (2, "$.a", "type string"), (3, "$.b", "type null"), (3, "$.c", "unknown field"), (3, "$.c.d", "unknown field")]


def test_learned_contract(spark):
    rows = [(i, f"name {i % 7}", i * 1.5, None if i % 4 else "x") for i in range(80)]
    a = spark.createDataFrame(rows, "k long, name string, v double, note string")
    b = a.select("k", F.struct(F.upper("name").alias("title"), (F.col("v") + 2).alias("v")).alias("out"))
    made = K.learn(a, b, ["k"])
    k = made.contract
    assert made.unexplained == [] and k.status == "draft" and set(k.required) == {"name", "v"} and k.problems() == []
    assert k.output.fields["out"].fields["title"].values == [f"NAME {i}" for i in range(7)]
    assert {r["status"] for r in K.run(k, a).collect()} == {"passed"}
    assert K.schema_violations(k, b, "output").count() == 0 and K.schema_violations(k, a).count() == 0
    broken = a.withColumn("name", F.when(F.col("k") == 3, None).otherwise(F.col("name")))
    assert [r["k"] for r in K.run(k, broken).where("status = 'quarantined'").collect()] == [3]
    other = b.withColumn("out", F.struct(F.col("out.title").alias("title"), F.when(F.col("k") == 5, -1.0).otherwise(F.col("out.v")).alias("v")))
    assert [tuple(r) for r in K.check_paths(k, a, other.where("k <> 9")).orderBy("k").collect()] == [(5, "out.v", "9.5", "-1"), (9, "$", "row", None)]
    unruly = K.learn(a, a.select("k", F.xxhash64("k").alias("h")), ["k"])
    assert unruly.unexplained == ["h"] and unruly.contract.status == "review_required"


def test_nodes_are_made_in_one_pass(spark):
    """No level reads the documents again; what hides its depth (an array of several types) is still taken apart whole."""
    df = spark.createDataFrame([(1, '{"a":{"b":[{"c":1}]},"e":{},"f":[]}'), (2, "[1]"), (3, None), (4, "7")], "k int, doc string")
    found = D.nodes(df, ["k"], "doc")
    assert {(r["k"], r["at"], r["above"], r["type"], r["text"]) for r in found.collect()} == {
        (1, "$", None, "object", None), (1, "$.a", "$", "object", None), (1, "$.a.b", "$.a", "array", None), (1, "$.a.b[0]", "$.a.b", "object", None), (1, "$.a.b[0].c", "$.a.b[0]", "integer", "1"),
        (1, "$.e", "$", "object", None), (1, "$.f", "$", "array", None), (2, "$", None, "array", None), (2, "$[0]", "$", "integer", "1"), (4, "$", None, "integer", "7"),
    }
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    mixed = spark.createDataFrame([(1, '{"a":[1,{"b<":[[{"VARIANT":{"`<x":null}}]]}]}')], "k int, doc string")
    assert D.nodes(mixed, ["k"], "doc").where("type = 'null'").first()["at"] == '$.a[1]["b<"][0][0].VARIANT["`<x"]'
    rows = {r["path"]: tuple(r)[1:] for r in D.leaf_profile(found).collect()}
    assert rows == {"$": ("integer", 1, 1, 0, 0, 0), "$[]": ("integer", 1, 1, 0, 0, 0), "$.a.b[].c": ("integer", 1, 1, 0, 0, 0)}


def test_shape_of_typed_rows_is_that_of_their_nodes(spark, monkeypatch):
    """Typed rows are counted without variants: the same shape, whatever is null, nested, whole or quoted."""
    from decimal import Decimal

    kind = "k int, t string, few string, n double, d decimal(5,2), f float, b boolean, day date, `a b` int, r struct<x: string, s: struct<y: double, z: array<string>>>, l array<struct<p: bigint, q: array<double>, w: string>>, m array<array<string>>"
    import datetime

    day = datetime.date(2024, 1, 2)
    rows = [(i, f"t{i}", "ab"[i % 2], float(i), Decimal("1.00"), 0.5, True, day, None if i == 3 else 1, ("x", (1.0, ["u", None])) if i % 3 else None, [(1, [1.0, float("nan")], "w"), None, (None, None, "v")] if i % 4 else None, [["c"], None, ["d", None]]) for i in range(30)]
    rows += [(30, None, None, 0.5, Decimal("1.50"), float("inf"), None, None, None, ("x", None), [], None), (31, "t", "a", None, None, 2.0, False, day, 2, (None, (None, [])), [(1, [], None)], [])]
    df = spark.createDataFrame(rows, kind)
    columns = df.columns[1:]
    for part in (df, df.limit(0), df.where("k = 30"), df.where("k IN (3, 31)")):
        docs = part.select("k", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"))
        for values in (False, True):
            wanted = D.shape(D.nodes(docs, ["k"], "_doc"), values).schema(True)
            assert D.shape_of_rows(part, columns, values).schema(True) == wanted
    other = df.select("k", F.create_map(F.col("t"), F.col("n")).alias("m")).where("t IS NOT NULL")  # only a variant shows a map's paths
    assert D.shape_of_rows(other, ["m"]).fields["m"].fields.keys() == {f"t{i}" for i in range(30)} | {"t"}
    monkeypatch.setattr(D, "nodes", None)
    assert D.shape_of_rows(df, columns, True).fields["few"].values == ["a", "b"]


def test_sizes_of_sources_and_maps_in_another_order(spark):
    from tracewright.operators import infer as I

    df = spark.range(5000).select("id", (F.col("id") % 37).alias("m"), F.lit(None).cast("string").alias("no"), F.expr("map('a', id, 'b', 1)").alias("one"), F.expr("map('b', 1L, 'a', id)").alias("two"), F.expr("map('a', id, 'b', 2L)").alias("three"))
    sizes = I.source_sizes(df, ["id", "m", "no"])
    assert sizes[""] == 5000 and sizes["m"] == 37 and sizes["no"] == 0 and abs(sizes["id"] - 5000) < 500
    assert "hll" not in df.select(I.same(F.col("one"), "two", df))._jdf.queryExecution().toString()
    got = df.select(I.same(F.expr("map('b', 1L, 'a', id)"), "two", df).alias("x"), I.same(F.expr("map('a', id, 'b', 1L)"), "two", df).alias("y"), I.same(F.col("three"), "two", df).alias("z"), I.same(F.lit(None).cast("map<string,bigint>"), "two", df).alias("n")).distinct().collect()
    assert [tuple(r) for r in got] == [(True, True, False, False)]
