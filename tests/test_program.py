"""Values, paths, programs, inference, verification, contracts, formats and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import patterns as X
from tracewright.functions import values as V
from tracewright.operators import compare as C
from tracewright.operators import contract as K
from tracewright.operators import infer as I
from tracewright.operators import profile as P
from tracewright.operators import signal as S
from tracewright.operators import verify as R
from tracewright.plans import export
from tracewright.plans.program import Op, at, dump, load, parse_path, run
from tracewright.sources import formats
from tracewright.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_paths():
    assert parse_path('$.a[0]["b c"].d') == ["a", 0, "b c", "d"]
    with pytest.raises(ValueError):
        parse_path("$.__proto__")
    with pytest.raises(ValueError):
        parse_path("$.a-")


def test_path_out_of_range_is_null(spark):
    df = spark.sql("SELECT array(named_struct('x', 1)) AS a")
    assert df.select(at("$.a[0].x").alias("p"), at("$.a[5].x").alias("q")).first() == (1, None)


@pytest.mark.parametrize(("text", "want"), [("12", 12.0), (" 1.5e2 ", 150.0), ("0x10", None), ("1d", None), ("", None), ("abc", None), (None, None)])
def test_number(spark, text, want):
    assert one(spark, V.number(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("mode", "want"), [("half-up", -2.0), ("half-away", -3.0), ("half-even", -2.0), ("floor", -3.0), ("ceil", -2.0), ("trunc", -2.0), ("none", -2.5)])
def test_rounding_rules(spark, mode, want):
    assert one(spark, V.rounded(F.lit(-2.5), mode, 0)) == want


def test_texts(spark):
    assert one(spark, V.title(F.lit("mary-ann o'neil"))) == "Mary-Ann O'Neil"
    assert one(spark, V.trimmed(F.lit(" ﻿ a \t"))) == "a"
    assert one(spark, V.collapsed(F.lit(" a \t b c "))) == "a b c"
    assert one(spark, V.quantity(F.lit("512Mi"), 1024, "Ki")) == "524288Ki"
    assert one(spark, V.decoded_key(F.lit("a%2Fb+c"))) == "a/b c"
    assert one(spark, V.decoded_key(F.lit("%zz+c"))) == "%zz c"
    assert one(spark, F.to_json(F.struct(V.split_at(F.lit("a.b..c"), ".").alias("x")))) == '{"x":["a","b","","c"]}'


@pytest.mark.parametrize(("text", "want"), [("2026-02-03", "2026-02-03"), ("2026/02/03", "2026-02-03"), ("03/02/2026", "2026-02-03"), ("03-02-2026", "2026-02-03"), ("2026-02-30", None), ("3/2/2026", None)])
def test_dates(spark, text, want):
    assert one(spark, V.date_text(F.lit(text), "isoDate")) == want


def fnv(data, seed=0x811C9DC5):
    for c in data:
        seed = (seed ^ c) * 16777619 & 0xFFFFFFFF
    return f"{seed:08x}"


def test_hashes(spark):
    for text in ("", "a", "é😀"):
        assert one(spark, V.text_hash(F.lit(text))) == fnv(text.encode())
        units = text.encode("utf-16-be")
        codes = [units[i] << 8 | units[i + 1] for i in range(0, len(units), 2)]
        assert one(spark, V.fingerprint(F.lit(text))) == fnv(codes) + fnv(codes, 0x01000193)


PROGRAM = [
    Op("set", "$.who.name", {"source": "name"}),
    Op("valueMap", "$.who.state", {"source": "s", "map": {"a": "active", "b": "blocked"}}),
    Op("numericTransform", "$.cents", {"source": "price", "mode": "multiply", "value": 100}),
]


def test_program_round_trip_and_nesting(spark):
    assert load(dump(PROGRAM)) == PROGRAM
    df = spark.createDataFrame([("x", "a", "1.5"), ("y", "z", None)], "name string, s string, price string")
    out = run(df, PROGRAM, keep=("name",), explain=True)
    rows = [json.loads(r) for r in out.toJSON().collect()]
    assert rows[0]["who"] == {"name": "x", "state": "active"} and rows[0]["cents"] == 150.0 and rows[0]["diagnostics"] == []
    assert {(d["code"], d["path"]) for d in rows[1]["diagnostics"]} == {("unseen-value", "$.who.state"), ("missing-source", "$.cents")}


def test_program_is_one_projection(spark):
    plan = run(spark.range(3).selectExpr("cast(id AS string) AS name", "'a' AS s", "id AS price"), PROGRAM)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_unknown_operator(spark):
    with pytest.raises(ValueError):
        run(spark.range(1), [Op("fly", "x", {})])


@pytest.mark.parametrize(("op", "make"), [
    (Op("stringCase", "t", {"source": "name", "mode": "upper"}), "upper(name)"),
    (Op("splitPart", "t", {"source": "code", "separator": "-", "index": 1}), "split(code, '-')[1]"),
    (Op("numericBinary", "t", {"left": "p", "right": "q", "mode": "multiply"}), "p * q"),
    (Op("concat", "t", {"sources": ["name", "code"], "separators": ["/"]}), "concat(name, '/', code)"),
])
def test_inference_round_trip(spark, op, make):
    df = spark.range(60).selectExpr("id", "concat('n', cast(id * 7 % 13 AS string), 'x') AS name", "concat('k', id % 5, '-', id * 3) AS code", "double(id) + 2 AS p", "double(id % 7) + 3 AS q")
    pairs = df.withColumn("_t", F.expr(make))
    rule = I.infer(pairs, ["name", "code", "p", "q"], {"t": "_t"})[0]
    assert rule.status == "exact" and rule.matches == 60
    assert pairs.where(~I.agrees("_t", rule.op)).count() == 0
    assert rule.op.kind == op.kind


def test_verify_names_the_corrupted_rows(spark):
    a = spark.range(400).selectExpr("id", "concat('Name ', id) AS name", "double(id) AS price")
    b = a.selectExpr("id", "CASE WHEN id IN (17, 230) THEN 'broken' ELSE upper(name) END AS label", "price * 100 AS cents")
    v = R.verify(a, b, ["id"])
    assert v.verdict == "inconsistent" and sorted(tuple(r) for r in v.flagged.collect()) == [(17, "label"), (230, "label")]


def test_verify_refuses_to_guess(spark):
    a = spark.range(50).selectExpr("id", "concat('n', id) AS name")
    assert R.verify(a, a.selectExpr("id", "md5(cast(id * 31 AS string)) AS label"), ["id"]).verdict == "unverifiable"
    assert R.verify(a, a.where("id < 40").selectExpr("id", "upper(name) AS label"), ["id"]).verdict == "unverifiable"


def test_compare_tolerance_and_duplicates(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (4, 4.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.004), (2, 2.5), (4, 4.0), (5, None)], "k int, v double")
    found = {r["k"]: (r["status"], r["fields"]) for r in C.rows_keyed(a, b, ["k"], absolute=0.01).collect()}
    assert found == {1: ("unchanged", ""), 2: ("changed", "v"), 3: ("removed", ""), 4: ("duplicate-key", ""), 5: ("added", "")}


def test_profile_of_empty_table(spark):
    empty = spark.createDataFrame([], "k int, v double, s string")
    assert P.numeric(empty, ["v"]).count() == 0
    assert P.histogram(empty, "v").count() <= 1
    assert P.duplicates(empty, ["k"]).count() == 0


def test_signal_marks_the_fatal_line(spark):
    text = "\n".join(["INFO job 12 done in 30 ms"] * 30 + ["FATAL out of memory"] + ["INFO job 13 done in 31 ms"] * 30)
    found = S.findings(S.lines(spark.createDataFrame([(1, text)], "d int, text string"), "d"), "d")
    top = found.where("rank = 1").first()
    assert (top["line_no"], top["level"]) == (31, "attention")


def contract(**more):
    return K.Contract(PROGRAM[2:], {"name": "string"}, [{"kind": "output_path_present", "path": "cents"}], key=["name"], **more)


def test_contract_lifecycle(spark):
    c = contract()
    with pytest.raises(ValueError):
        c.approve("0" * 16)
    c.approve(c.fingerprint())
    assert c.problems() == []
    c.policy = "block"
    assert c.problems() == ["changed after approval"]
    with pytest.raises(ValueError):
        K.run(contract().revoke(), spark.range(1))
    assert K.differences(contract(), contract(policy="warn")) == [{"part": "policy", "change": "changed", "effect": "reapproval"}]


def test_contract_quarantines(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "x"), (None, "2")], "name string, price string")
    assert sorted((r["name"] or "", r["status"]) for r in K.run(contract(), df).collect()) == [("", "quarantined"), ("a", "passed"), ("b", "quarantined")]


@pytest.mark.parametrize(("text", "kind"), [('{"a": 1}', "json"), ("<a><b/></a>", "xml"), ("INSERT INTO t (a) VALUES (1);", "sql"), ("A=1\nB=2", "env"), ("[x]\na = 1", "toml"), ("a,b\n1,2", "csv"), ("a: 1\nb:\n  - 2", "yaml")])
def test_detect(text, kind):
    assert formats.detect(text) == kind


def test_inserts_and_env():
    rows = formats.parse_inserts("-- c\nINSERT INTO t (a, b) VALUES (1, 'it''s'), (NULL, now());")
    assert rows == [{"table": "t", "row": {"a": 1, "b": "it's"}}, {"table": "t", "row": {"a": None, "b": "[SQL expression: now()]"}}]
    assert formats.parse_env("# c\nexport A=\"x\\ny\"\nB='z' # c\nC=1 # d\n") == {"A": "x\ny", "B": "z", "C": "1"}
    with pytest.raises(ValueError):
        formats.parse_env("A=1\nA=2")


def test_read_files(spark, tmp_path):
    (tmp_path / "a.toml").write_text("d = 2026-01-02\n[x]\ny = 0x10\n")
    row = formats.read_texts(spark, str(tmp_path / "a.toml"), "toml").first()
    assert json.loads(row["value"]) == {"d": "2026-01-02", "x": {"y": 16}} and row["error"] is None
    (tmp_path / "b.toml").write_text("a = = 1")
    assert formats.read_texts(spark, str(tmp_path / "b.toml"), "toml").first()["error"].startswith("toml:")
    (tmp_path / "c.csv").write_text("id;zip;n;ok\n007;01234;1.5;true\n8;99999;2;false\n")
    df = formats.read_csv(spark, str(tmp_path / "c.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "string", "double", "boolean"]
    (tmp_path / "d.sql").write_text("INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y');")
    assert formats.read_inserts(spark, str(tmp_path / "d.sql")).count() == 2
    (tmp_path / "e.xml").write_text("<r><i id='1'>x</i><i id='2'>y</i></r>")
    assert [tuple(r) for r in formats.read_xml(spark, str(tmp_path / "e.xml"), "i").orderBy("`@id`").select("`@id`", "`#text`").collect()] == [("1", "x"), ("2", "y")]


def test_csv_formula_guard(spark, tmp_path):
    formats.write_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o"), header=True).first()["a"] == "'=1+1"


def test_exports(spark):
    df = spark.createDataFrame([("x", "a", 2.0)], "name string, s string, price double")
    df.createOrReplaceTempView("exported")
    program = [Op("set", "n", {"source": "name"}), *[Op(o.kind, t, o.params) for o, t in zip(PROGRAM[1:], ("state", "cents"), strict=True)]]
    assert tuple(spark.sql(export.spark_sql(program, "exported")).first()) == tuple(run(df, program).first())
    scope: dict = {}
    exec(export.pyspark(program), scope)  # noqa: S102
    assert scope["transform"](df).first() == run(df, program).first()
    assert export.jq([Op("set", "a", {"source": "$.b[0].c"})]) == '{"a": .b[0].c}'


def test_regex_synthesis():
    p = X.synthesize(["AB-12", "CD-345"], ["ab-12"])
    assert p == r"^[A-Z]{2}\-\d{2,3}$" or __import__("re").search(p, "XY-99")
    assert X.synthesize(["a1", "1a"]) is None


def test_contract_stream_splits(spark, tmp_path):
    spark.createDataFrame([("a", "1"), ("b", "x")], "name string, price string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, price string").parquet(str(tmp_path / "in"))
    q = streams.split_sinks(streams.contract_stream(contract(), stream), str(tmp_path / "good"), str(tmp_path / "held"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.parquet(str(tmp_path / "held")).count() == 1


def test_rate_windows_on_a_stream(spark, tmp_path):
    spark.sql("SELECT 'u' AS c, timestamp'2026-01-01 00:00:01' + make_interval(0, 0, 0, 0, 0, 0, id * 10) AS ts FROM range(9)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("c string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.rate_windows(stream, "c", "ts", most=4, late="1 minute").writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [(r["requests"], r["refused"]) for r in spark.table("rates").orderBy("start").collect()] == [(6, 2), (3, 0)]
