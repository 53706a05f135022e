"""Quoted records over splits of every size, against Python's reader and DuckDB's; statements over splits."""

import csv
import json
import random

import duckdb
import pytest

from tracewright.sources import formats
from tracewright.sources.quoted import quoted_records, read_quoted_csv


def small(spark, size):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    return session


def some(seed, n=400):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "b", '"', ",", "\n", "\n\n", "é", " ", ";"]) for _ in range(rng.randrange(25)))
    return [(str(i), cell(), "x" * rng.randrange(3)) for i in range(n)] + [("long", "line\n" * 500, "y")]


@pytest.mark.parametrize("size", [97, 1_000, 1 << 30])
def test_csv_over_splits(spark, tmp_path, size):
    rows = some(size)
    for part, own in (("a.csv", rows[:150]), ("b.csv", rows[150:])):
        with open(tmp_path / part, "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerows([("id", "some text", "c"), *own])
    df = read_quoted_csv(small(spark, size), str(tmp_path))
    got = sorted(tuple(v or "" for v in r) for r in df.collect())
    assert df.columns == ["id", "some text", "c"] and got == sorted(rows)
    other = duckdb.sql(f"SELECT * FROM read_csv('{tmp_path}/*.csv', header = true, all_varchar = true, quote = '\"', escape = '\"', delim = ',', auto_detect = false, columns = {{'id': 'VARCHAR', 'some text': 'VARCHAR', 'c': 'VARCHAR'}})").fetchall()
    assert got == sorted(tuple(v or "" for v in r) for r in other)


def test_without_header_and_ragged(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1;"x\n;y"\n\n2;z\n')
    assert [tuple(r) for r in read_quoted_csv(spark, str(tmp_path / "a.csv"), ";", header=False, columns=["a", "b"]).collect()] == [("1", "x\n;y"), ("2", "z")]
    (tmp_path / "b.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_quoted_csv(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="unique"):
        read_quoted_csv(spark, str(tmp_path / "c.csv"))
    (tmp_path / "d.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_quoted_csv(spark, str(tmp_path / "d.csv"))


@pytest.mark.parametrize("size", [61, 500, 1 << 30])
def test_statements_over_splits(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(i, "".join(rng.choice(["a", "'", "\n", ";", "(", ",", " "]) for _ in range(rng.randrange(20)))) for i in range(200)]
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    texts = [f"INSERT INTO t (a, b)\nVALUES ({i},\n {quoted(t)});" for i, t in rows]
    (tmp_path / "d.sql").write_text("\n".join(texts) + "\n")
    got = formats.read_inserts(small(spark, size), str(tmp_path / "d.sql")).collect()
    assert sorted((r["a"], r["b"]) for r in (json.loads(x["row"]) for x in got)) == rows
    assert quoted_records(small(spark, size), str(tmp_path / "d.sql"), "'", ";").count() == 200


def test_comments_inside_quotes_stay(spark, tmp_path):
    text = "-- it's a comment\nINSERT INTO t (a) VALUES ('x -- y'), ('/* z */'); /* no's */\n"
    assert [r["row"]["a"] for r in formats.parse_inserts(text)] == ["x -- y", "/* z */"]
    (tmp_path / "d.sql").write_text(text)
    assert formats.read_inserts(spark, str(tmp_path / "d.sql")).count() == 2


def test_splits_grow_with_the_files(spark, tmp_path, monkeypatch):
    from tracewright.sources import source_queries as Q

    (tmp_path / "a.csv").write_bytes(b"x" * 400_000)
    size = lambda: int(Q._small_splits(spark, f"file://{tmp_path}").conf.get("spark.sql.files.maxPartitionBytes"))
    assert size() == Q.SPLIT
    monkeypatch.setattr(Q, "SPLITS", 4)
    assert size() == 100_000


def test_csv_query_gives_every_row(spark):
    from tracewright.sources import source_queries as Q

    sf = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("string(doc_id)", "nullif(text, '')", "lang")
    assert sorted(map(repr, map(tuple, Q._csv(spark, sf).collect()))) == sorted(map(repr, map(tuple, want.collect())))
