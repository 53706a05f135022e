"""The search for rules: samples, consensus, lookups of any size, nested and array targets, matching, ambiguity, positions."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import ambiguity as A
from tracewright.operators import consensus as C
from tracewright.operators import infer as I
from tracewright.operators import matching as M
from tracewright.operators import verify as R
from tracewright.operators.generators import suggestions
from tracewright.plans.program import Op, run
from tracewright.sources.positions import POSITION, numbered, paired


def test_reservoirs_hold_the_smallest_hashes(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    got = {}
    for r in C.reservoirs(df.repartition(7), ["k"], seeds=4, size=6).collect():
        got.setdefault(r["seed"], set()).add(r["k"])
    draw = lambda s: F.shiftrightunsigned(F.xxhash64(F.lit(s), "k"), 11)
    for s in range(4):
        assert got[s] == {r["k"] for r in df.orderBy(draw(s), "k").limit(6).collect()}
    few = C.reservoirs(spark.range(3).withColumnRenamed("id", "k"), ["k"], seeds=2, size=6)
    assert few.count() == 6


def three_rules(n=240):
    rows = []
    for i in range(n):
        kind = i % 20
        y = i * 3 if kind < 12 else i + 1000 if kind < 18 else -7 * i * i - 13 * (i % 11)
        rows.append((i, i, y))
    return rows


def test_consensus_peels_rules(spark):
    pairs = spark.createDataFrame(three_rules(), "k long, a long, _y long")
    found = C.consensus(pairs, ["k"], ["a"], "y", "_y")
    assert found.verdict == "inconsistent" and [(c.rule.op.params["mode"], c.support) for c in found.clusters] == [("multiply", 144), ("add", 72)] and found.unexplained == 24


def test_a_tie_accuses_nobody(spark):
    a = spark.createDataFrame([(i, i, i * 10 if i % 2 else i + 5000) for i in range(100)], "k long, a long, y long")
    found = R.verify(a.select("k", "a"), a.select("k", "y"), ["k"])
    assert found.verdict == "unverifiable" and found.flagged.count() == 0 and [c.support for c in found.clusters["y"].clusters] == [50, 50]


def test_majority_is_flagged_where_it_breaks(spark):
    rng = random.Random(2)
    rows = [(i, f"name {i % 9}", f"NAME {i % 9}" if i % 8 else f"junk{rng.random()}") for i in range(160)]
    a = spark.createDataFrame(rows, "k long, a string, y string")
    found = R.verify(a.select("k", "a"), a.select("k", "y"), ["k"])
    assert found.verdict == "inconsistent" and {r["k"] for r in found.flagged.collect()} == set(range(0, 160, 8))
    assert R.verify(a.select("k", "a"), a.select("k", "y"), ["k"], search=False).verdict == "unverifiable"


def test_lookup_of_many_keys_is_a_table(spark, tmp_path):
    rows = [(i, f"k{i % 700}", f"v{(i % 700) * 37 % 701}") for i in range(2800)]
    pairs = spark.createDataFrame(rows, "i long, code string, _y string")
    rule = I.infer(pairs, ["i", "code"], {"y": "_y"})[0]
    assert rule.status == "exact" and rule.op.params == {"source": "code", "keys": 700} and rule.table.count() == 700
    op = I.saved(rule, str(tmp_path / "lookup"))
    out = run(pairs, [op, Op("set", "i", {"source": "i"})], keep=("_y",))
    assert out.where("y = _y").count() == 2800 and out.columns == ["_y", "y", "i"]
    best = I.best_lookup(pairs.withColumn("noise", F.col("i") % 5), ["noise", "code"], "y", "_y")
    assert best.op.params["source"] == "code"


def test_a_memorised_lookup_is_none(spark):
    pairs = spark.createDataFrame([(f"k{i}", f"v{i * i}") for i in range(400)], "code string, _y string")
    assert I.infer(pairs, ["code"], {"y": "_y"})[0].op is None


def test_rare_outputs_are_in_the_evidence(spark):
    pairs = spark.createDataFrame([(i, "rare" if i == 7 else "usual") for i in range(3000)], "i long, _y string")
    rows = I.evidence(pairs, ["i", "_y"], ["_y"])
    assert len(rows) == I.EVIDENCE and any(r["_y"] == "rare" for r in rows)


@pytest.mark.parametrize(
    ("rows", "op"),
    [
        ([{"a": [1, 2], "_out": 2}, {"a": [3], "_out": 1}, {"a": [], "_out": 0}], Op("arrayCount", "t", {"source": "a"})),
        ([{"a": [{"x": "u", "n": 1}, {"x": "v", "n": 2}], "_out": [2]}, {"a": [{"x": "v", "n": 5}], "_out": [5]}], Op("arrayMap", "t", {"source": "a", "where": {"path": "x", "equals": "v"}, "extract": "n"})),
        ([{"a": [{"x y": 2, "n": 3}], "_out": 6.0}, {"a": [{"x y": 4, "n": 5}, {"x y": 1, "n": 1}], "_out": 21.0}], Op("arraySum", "t", {"source": "a", "divisor": 1, "factors": ['["x y"]', "n"]})),
        ([{"a": "x;y", "_out": ["x", "y"]}, {"a": "z;w;q", "_out": ["z", "w", "q"]}], Op("stringSplit", "t", {"source": "a", "separator": ";", "trim": False})),
        ([{"a": None, "b": "q", "_out": "q"}, {"a": "w", "b": "e", "_out": "w"}], Op("fallback", "t", {"sources": ["a", "b"]})),
    ],
)
def test_suggestions(rows, op):
    assert repr(op) in {repr(o) for o in suggestions(rows, [k for k in rows[0] if k != "_out"], "t")}


def test_nested_targets_are_learned_and_built(spark):
    rows = [(i, (f"n{i}", (i * 2,)), [{"s": "a" if j % 2 else "b", "q": j + i} for j in range(i % 4)]) for i in range(60)]
    a = spark.createDataFrame(rows, "k long, p struct<name: string, in: struct<v: long>>, xs array<struct<s: string, q: long>>")
    wanted = a.select("k", F.struct(F.upper("p.name").alias("title"), F.struct(F.col("p.in.v").alias("deep")).alias("more")).alias("out"), F.size(F.filter("xs", lambda x: x["s"] == "a")).alias("n"))
    pairs, inputs, outputs = R.aligned_paths(a, wanted, ["k"])
    rules = {r.target: r for r in I.infer(pairs, inputs, outputs)}
    assert {t: (r.op.kind, r.status) for t, r in rules.items()} == {"out.title": ("stringCase", "exact"), "out.more.deep": ("set", "exact"), "n": ("arrayCount", "exact")}
    made = run(a, [r.op for r in rules.values()], keep=("k",))
    assert sorted(map(str, made.select("k", "out", "n").collect())) == sorted(map(str, wanted.collect()))


def test_leaves_quote_odd_names(spark):
    df = spark.sql("SELECT 1 AS `a b`, named_struct('c.d', 2) AS s")
    assert R.leaves(df.schema) == ['["a b"]', 's["c.d"]']


def test_overlaps_count_values_not_rows(spark):
    a = spark.createDataFrame([(1, "x", 5.0), (1, "y", 6.0), (2, None, 7.5)], "i long, s string, d double")
    b = spark.createDataFrame([("5", "x"), ("6", "x"), ("1", "z")], "n string, t string")
    got = {(r["source"], r["target"]): (r["shared"], r["source_values"], r["target_values"]) for r in M.overlaps(a, b, a.columns, b.columns).collect()}
    assert got == {("i", "n"): (1, 2, 3), ("s", "t"): (1, 2, 2), ("d", "n"): (2, 3, 3)}
    assert M.affinity("customerName", "customer_name") == 1.0 and M.affinity("a", "zzz") < 0.2


def test_confidence(spark):
    rows = [(i, i * 1.0, i * 1.0 if i % 5 else i + 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    seen = df.where("k % 5 <> 0").withColumn("_y", F.col("a"))
    found = A.triage(seen, df, "k", ["a", "b"], {"y": "_y"})
    assert found["y"].status == "ambiguous" and found["y"].alternatives[0].witness == 0 and found["y"].alternatives[0].differs == 10
    assert A.confidence(found)["label"] == "needs-proof"
    sure = A.triage(seen.drop("b"), df.drop("b"), "k", ["a"], {"y": "_y"})
    assert A.confidence(sure) == {"label": "proven", "passed": 6, "total": 6, "failed": []} and A.confidence(sure, 1)["label"] == "unsafe"
    assert A.preconditions(df, [found["y"].selected]) == [{"path": "a", "type": "double", "required": True, "present": 50, "rows": 50}]


def test_positions_of_several_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(0, 1000, 1, 7).withColumn("v", F.col("id") * 2).write.parquet(path)
    rows = numbered(spark, path).orderBy(POSITION).collect()
    assert [r[POSITION] for r in rows] == list(range(1000)) and [r["id"] for r in rows] == list(range(1000))
    other = numbered(spark, path, ["v"]).where(f"{POSITION} < 990")
    both = paired(numbered(spark, path), other)
    assert both.where("right_v = v").count() == 990 and both.where("right_v IS NULL").count() == 10


def test_verify_files_by_position(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(0, 400, 1, 3).select(F.concat(F.lit("n"), "id").alias("name")).write.parquet(a)
    spark.range(0, 400, 1, 5).select(F.when(F.col("id") == 77, "?").otherwise(F.concat(F.lit("N"), "id")).alias("name")).write.parquet(b)
    found = R.verify_files(a, b, spark)
    assert found.verdict == "inconsistent" and [r[POSITION] for r in found.flagged.collect()] == [77]


def test_a_guard_is_learned_with_its_rule(spark):
    rows = [(i, f"nn{i}", None if i % 3 else "yes", None if i % 3 else f"NN{i}", None if i % 3 else "gift") for i in range(90)]
    pairs = spark.createDataFrame(rows, "k long, name string, member string, _a string, _b string")
    found = {r.target: r for r in I.infer(pairs, ["k", "name", "member"], {"a": "_a", "b": "_b"})}
    assert (found["a"].op, found["a"].status) == (Op("stringCase", "a", {"source": "name", "mode": "upper", "domain": "member"}), "exact")
    assert (found["b"].op, found["b"].status) == (Op("constant", "b", {"value": "gift", "domain": "member"}), "exact")
    assert run(pairs, [found["b"].op], keep=("k",)).where("b IS NULL").count() == 60


def test_a_skewed_column_accuses_nobody(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), "open" if rng.random() < 0.65 else "shut") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a string, y string")
    found = R.verify(df.select("k", "a"), df.select("k", "y"), ["k"])
    assert found.verdict == "unverifiable" and found.flagged.count() == 0 and found.clusters["y"].clusters == []


def test_copies_of_rows_do_not_crowd_out_the_evidence(spark):
    """Each row 60 times: the first 200 by hash are copies of a few, and none of them may lack the optional field."""
    rows = [(f"P{i % 5}", float(i) if i % 2 else None) for i in range(400)]
    pairs = spark.createDataFrame(rows, "name string, member double").crossJoin(spark.range(60)).drop("id")
    pairs = pairs.withColumn("_y", F.when(F.col("member").isNotNull(), F.lower("name")))
    known = I.evidence(pairs, ["name", "member", "_y"], ["_y"])
    assert len(known) == len({tuple(r) for r in known}) == I.EVIDENCE and any(r["_y"] is None for r in known)
    rule = I.infer(pairs, ["name", "member"], {"y": "_y"})[0]
    assert rule.status == "exact" and rule.op.kind == "stringCase" and rule.op.params["domain"] == "member"


def test_an_exact_rule_spares_the_others(spark, monkeypatch):
    counted = []
    supports = I.supports
    monkeypatch.setattr(I, "supports", lambda pairs, tests, most=24: counted.append(len(tests)) or supports(pairs, tests, most))
    pairs = spark.createDataFrame([(i, i * 2, f"n{i}", f"N{i}") for i in range(1, 300)], "k long, a long, b string, c string").withColumns({"_x": F.col("k") * 3, "_z": F.upper("b")})
    found = I.infer(pairs, ["k", "a", "b", "c"], {"x": "_x", "z": "_z"})
    assert [(r.status, r.matches) for r in found] == [("exact", 299)] * 2 and counted[-2:] == [2, 0]
    every = I.candidates(pairs, ["k", "a", "b", "c"], {"x": "_x", "z": "_z"})
    assert [repr(r.op) for r in found] == [repr(every[t][0].op) for t in ("x", "z")] and counted[-1] > 2


def test_numbering_moves_no_file_into_one_task(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).repartition(2).write.parquet(path)
    plan = numbered(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = numbered(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)


def test_arrays_of_one_type_are_compared_without_json(spark):
    rows = [(1, [1, 2], ["1", "2"], [(1, None)]), (2, None, None, None), (3, [3, None], ["3", None], [(3, "x")]), (4, [4], ["5"], [(4, "y")])]
    df = spark.createDataFrame(rows, "k int, a array<int>, s array<string>, r array<struct<p:int,m:string>>")
    a, renamed = F.col("a"), F.transform("r", lambda x: F.struct(x["p"].alias("q"), x["m"].alias("m")))
    got = df.select(
        I.same(a, "a", df).alias("equal"), I.same(F.reverse("a"), "a", df).alias("turned"), I.same(a.cast("array<bigint>"), "a", df).alias("wider"), I.same(a.cast("array<string>"), "s", df).alias("texts"),
        I.same(F.col("r"), "r", df).alias("records"), I.same(renamed, "r", df).alias("renamed"), I.same(F.when(F.col("k") < 3, F.col("r")), "r", df).alias("missing"),
    ).collect()
    assert [tuple(r) for r in got] == [(True, False, True, True, True, False, True), (True,) * 7, (True, False, True, True, True, False, False), (True, True, True, False, True, False, False)]
    plan = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" in plan(I.same(F.reverse("a"), "a", df)) and "<=>" not in plan(I.same(a.cast("array<bigint>"), "a", df))


def test_only_distinct_values_become_texts(spark):
    """Odd values and more columns than one number has bits, against plain Python; no cell of a row is made a text."""
    a = spark.createDataFrame([(1, 1.0, -0.0, "1.0", None), (2, 2.5, 0.0, "x", None), (2, float("nan"), 7.0, "2.50", None)], "i int, d double, z double, s string, n long")
    wide = {f"w{j}": F.col("i").cast("long") + j % 3 for j in range(70)}
    b = a.select("i", F.col("s").alias("m"), F.col("z").alias("y"), *[v.alias(k) for k, v in wide.items()])

    def values(df):
        rows = df.select(*[F.regexp_replace(F.col(c).cast("string"), r"\.0+$", "").alias(c) for c in df.columns]).collect()
        return {c: {r[c] for r in rows} - {None} for c in df.columns}

    x, y = values(a), values(b)
    want = {(s, t): (len(x[s] & y[t]), len(x[s]), len(y[t])) for s in x for t in y if x[s] & y[t]}
    found = M.overlaps(a, b, a.columns, b.columns)
    assert {(r["source"], r["target"]): (r["shared"], r["source_values"], r["target_values"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("Generate" in line for line in plan) and not any("Generate" in line and "regexp_replace" in line for line in plan)
