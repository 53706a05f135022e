"""The command line on small tables."""

import json

from tracewright import cli
from tracewright.session import ship


def test_verify_and_contract(spark, tmp_path, capsys):
    a = spark.range(40).selectExpr("id", "concat('n', id) AS name", "double(id) AS price")
    a.write.parquet(str(tmp_path / "a"))
    a.selectExpr("id", "CASE WHEN id = 3 THEN 'x' ELSE upper(name) END AS label").write.parquet(str(tmp_path / "b"))
    assert cli.main(["verify", str(tmp_path / "a"), str(tmp_path / "b"), "--key", "id", "--out", str(tmp_path / "flagged")]) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["flagged"] == 1
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "flagged")).collect()] == [3]
    (tmp_path / "c.json").write_text(json.dumps({"program": [{"op": "numericTransform", "target": "cents", "source": "price", "mode": "multiply", "value": 100}], "required": {"id": "bigint"}, "key": ["id"]}))
    assert cli.main(["contract-run", str(tmp_path / "c.json"), str(tmp_path / "a")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["verdict"] == "pass"
    a.selectExpr("id", "price * 100 + int(id = 5) AS cents").write.parquet(str(tmp_path / "d"))
    assert cli.main(["contract-check", str(tmp_path / "c.json"), str(tmp_path / "a"), str(tmp_path / "d")]) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"unchanged": 39, "changed": 1}


def test_bad_arguments(spark):
    assert cli.main(["fly"]) == 3
    assert cli.main(["verify", "a", "b"]) == 3


def test_ship_twice(spark):
    ship(spark)
    ship(spark)


def said(capsys):
    return json.loads(capsys.readouterr().out.splitlines()[-1])


def test_a_contract_from_examples_to_approval(spark, tmp_path, capsys):
    a = spark.range(60).selectExpr("id", "concat('n', id) AS name", "double(id) AS price")
    a.write.parquet(str(tmp_path / "a"))
    a.selectExpr("id", "upper(name) AS label", "price * 100 AS cents").write.parquet(str(tmp_path / "b"))
    first, second = str(tmp_path / "one.json"), str(tmp_path / "two.json")
    assert cli.main(["contract-learn", str(tmp_path / "a"), str(tmp_path / "b"), "--key", "id", "--out", first]) == 0
    learned = said(capsys)
    assert {op["op"] for op in learned["program"]} == {"stringCase", "numericTransform"} and learned["unexplained"] == []
    assert cli.main(["contract-inspect", first]) == 0
    shown = said(capsys)
    assert shown["output"]["required"] == ["cents", "label"] and shown["output"]["additionalProperties"] is False
    assert cli.main(["contract-approve", first, "wrong", "--out", second]) == 2
    assert cli.main(["contract-approve", first, learned["fingerprint"], "--out", second]) == 0
    capsys.readouterr()
    assert cli.main(["contract-run", second, str(tmp_path / "a")]) == 0 and said(capsys)["verdict"] == "pass"
    assert cli.main(["contract-diff", first, second]) == 0 and said(capsys) == []
    assert cli.main(["contract-test", second, str(tmp_path / "a")]) == 1 and "unit cents" in said(capsys)["unnoticed"]
