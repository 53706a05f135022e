"""Streaming exact duplicates: brute force, several micro-batches, a stream that goes on, colliding digests, odd tables."""

import glob
import hashlib
import os
import re
import time

from pyspark.sql import functions as F

from tracewright.llm import exact_dedup as X

ROWS = [
    (5, "a  b", "en"), (3, "a b", "en"), (9, "a\tb", "de"), (4, "", "en"), (2, None, None), (1, "A b", "en"),
    (7, " a b", "en"), (8, "long " * 5000, "en"), (6, "long\n" * 5000, "en"), (3, "other", "fr"), (3, "other", "fr"), (None, "other", "fr"), (None, "alone", "fr"),
]


def brute(rows):
    """(id, keep id, size, kept) of every row; of equal ids the first row that Spark numbers stays, so only its count is fixed."""
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=str), len(groups)


def table(spark, tmp_path, rows, parts=3, name="documents"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts).selectExpr("*", "1 AS digest", "'x' AS file", "2 AS n", "3 AS row", "4 AS `first`", "5 AS kept").write.parquet(path)
    return path


def check(found, rows):
    got = found.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("d"), "kept").collect()
    want, groups = brute(rows)
    assert sorted([tuple(r)[:4] for r in got], key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups and len({r["d"] for r in kept}) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_against_brute_force(spark, tmp_path):
    check(X.exact_duplicates(spark, table(spark, tmp_path, ROWS)), ROWS)


def test_many_small_batches(spark, tmp_path):
    rows = [(i, f"text {i % 37}", "en") for i in range(300)] + ROWS
    check(X.exact_duplicates(spark, table(spark, tmp_path, rows, 9), batch_bytes=1), rows)


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, state = table(spark, tmp_path, ROWS), f"file://{tmp_path}/state"
    first = X.remember(spark, path, state)
    assert first.count() == brute(ROWS)[1]
    more = [(100, "a b", "en"), (0, "other", "en"), (101, "new", "en")]
    spark.createDataFrame(more, "doc_id long, text string, lang string").write.mode("append").parquet(path)
    check(X.exact_duplicates(spark, path, state), ROWS + more)
    again = {r["doc_id"]: r["n"] for r in X.remember(spark, path, state).collect()}  # nothing new: nothing counts twice
    assert again[0] == 4 and sum(again.values()) == len(ROWS) + 3


def test_equal_digests_of_other_texts_are_told_apart(spark, tmp_path):
    weak = lambda text: F.encode((F.length(text) % 3).cast("string"), "utf-8")
    rows = [(i, "w" * (i % 11), "en") for i in range(80)] + ROWS
    found = X.exact_duplicates(spark, table(spark, tmp_path, rows), digest=weak)
    got = found.select("doc_id", "keep_id", "group_size", "kept").collect()
    want, groups = brute(rows)
    assert sorted([tuple(r)[:3] for r in got], key=str) == sorted([w[:3] for w in want], key=str)
    assert sum(r["kept"] for r in got) == groups


def test_empty_table(spark, tmp_path):
    assert X.exact_duplicates(spark, table(spark, tmp_path, [], 1)).count() == 0


def test_ids_of_another_type(spark, tmp_path):
    path = str(tmp_path / "named")
    spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "doc_id string, text string").write.parquet(path)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in X.exact_duplicates(spark, path).collect()} == {("b", "a", False), ("a", "a", True), ("c", "c", True)}



def test_state_takes_no_disk_in_advance(spark, tmp_path):
    """A manifest of some hundred bytes in every partition, not 4 MB of reserved blocks."""
    local = spark.conf.get("spark.local.dir", "/tmp")
    began = time.time()
    X.remember(spark, table(spark, tmp_path, ROWS), f"file://{tmp_path}/state").count()
    made = [os.stat(f) for f in glob.glob(f"{local}/**/workingDir-*/MANIFEST-*", recursive=True)]
    made = [s for s in made if s.st_mtime >= began - 1]
    assert made and all(s.st_blocks * 512 < 1 << 20 for s in made)
