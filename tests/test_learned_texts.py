"""Patterns of unequal forms, picks of paths, programs as text."""

import re

import pytest

from tracewright.functions import alignment as A
from tracewright.functions.learned_queries import _PROGRAM
from tracewright.plans import export, picks
from tracewright.plans.program import Op, run


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (["AB-12", "CD-345", "EF-6"], r"^[A-Z]{2}\-\d{1,3}$"),
        (["v1.2", "v1.2.3", "v10.20", "v3.4.5"], None),
        (["ORD-1", "ORD-22-X", "ORD-3"], r"^ORD\-\d{1,2}(?:\-X)?$"),
        (["abc", "ABC", "aBc"], None),
        (["a b", "a  b", "cc dd"], None),
        (["(x)", "(yy)"], r"^\([a-z]{1,2}\)$"),
    ],
)
def test_pattern_meets_all_it_was_learned_from(spark, values, want):
    found = A.learned(texts(spark, values), "t")
    assert found.matches == found.rows == len(values)
    assert all(re.search(found.text, v) for v in values)
    assert want is None or found.text == want


def test_captures_and_groups(spark):
    df = texts(spark, ["ORD-1", "ORD-22-X", "ORD-3-Y", None, "else"])
    found = A.learned(df.where("t LIKE 'ORD%'"), "t", captures=True)
    got = {r["t"]: (r["matched"], r["groups"]) for r in A.tested(df, "t", found.text).collect()}
    assert got["ORD-22-X"] == (True, ["22", "X"]) and got["ORD-1"] == (True, ["1", ""]) and got["else"][0] is False and got[None][0] is False
    assert found.flavour("js").startswith("/^ORD") and found.flavour("python") == found.text
    with pytest.raises(ValueError):
        found.flavour("perl6")


def test_negatives_tighten_or_conflict(spark):
    good = texts(spark, ["red-1", "blue-2", "red-3"] * 3)
    found = A.learned(good, "t", texts(spark, ["pink-1", "grey-2"]))
    assert found.conflicts == 0 and found.matches == 9 and not re.search(found.text, "pink-1")
    assert A.learned(good, "t", texts(spark, ["red-1"])).conflicts == 1
    assert A.learned(texts(spark, [None, ""]), "t") is None


DOC = {"a": {"b c": 1}, "xs": [{"k": "u", "in": {"v": 1}}, {"k": "w", "in": {"v": 2}}, {"k": "u", "in": {"v": 3}}], "ns": [1, 2]}


def test_plans(spark):
    assert picks.plan(DOC, ['$.a["b c"]']).jq == '.a["b c"]'
    asked = picks.plan(DOC, ["xs[1].in.v"])
    assert asked.status == "ambiguous" and "every item of xs" in asked.question
    assert picks.plan(DOC, ["xs[1].in.v"], every=False).jsonpath == "$.xs[1].in.v"
    every = picks.plan(DOC, ["xs[1].in.v"], every=True)
    assert every.jq == "[.xs[] | .in.v]" and every.jsonpath == "$.xs[*].in.v"
    some = picks.plan(DOC, ["xs[0].in.v", "xs[2].in.v"])
    assert some.jq == '[.xs[] | select(.k == "u") | .in.v]' and some.jsonpath == '$.xs[?(@.k=="u")].in.v'
    assert picks.plan(DOC, ["xs[0].in.v", "xs[1].in.v"]).ops[0].params == {"source": "xs", "extract": "in.v"}
    assert picks.plan(DOC, ["xs[0].k", "ns[1]"]).jq == "[.xs[0].k, .ns[1]]"
    with pytest.raises(ValueError):
        picks.plan(DOC, [])
    df = spark.sql("SELECT array(named_struct('k', 'u', 'in', named_struct('v', 5)), named_struct('k', 'w', 'in', named_struct('v', 6))) AS xs")
    assert run(df, some.ops).first()["value"] == [5] and run(df, every.ops).first()["value"] == [5, 6]


def test_sql_text_does_what_the_program_does(spark):
    df = spark.sql("SELECT array(named_struct('flag', 'R', 'qty', 2.5D, 'part', 7), named_struct('flag', 'N', 'qty', 1D, 'part', 8)) AS lines, 'a+b' AS object, '' AS nick, 'me' AS login, named_struct('info', named_struct('status', 'F')) AS customer, 'p.q' AS dotted, -3 AS v, true AS yes")
    more = [Op("stringSplit", "parts2", {"source": "dotted", "separator": "."}), Op("numericCompare", "low", {"source": "v", "comparison": "lessThan", "value": 0}), Op("booleanNot", "no", {"source": "yes"}), Op("stringReplace", "swap", {"source": "dotted", "search": ".", "replacement": "'"}), Op("arrayFind", "found", {"source": "lines", "where": {"path": "flag", "equals": "N"}, "extract": "part"}), Op("arrayMap", "all", {"source": "lines", "extract": "part"})]
    df.createOrReplaceTempView("exported_rows")
    assert spark.sql(export.spark_sql([*_PROGRAM, *more], "exported_rows")).first().asDict() == run(df, [*_PROGRAM, *more]).first().asDict()


def test_jq_refuses_what_it_cannot_say():
    assert export.jq([Op("set", "o.x", {"source": "a.b"}), Op("constant", "c", {"value": 1})]) == '{"o": {"x": .a.b}, "c": 1}'
    with pytest.raises(ValueError, match="dateFormat"):
        export.jq([Op("dateFormat", "d", {"source": "s", "mode": "isoDate"})])
