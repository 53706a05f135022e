"""Repeated rows and ids of several texts in the n-gram join."""

import random

from test_jaccard_join import brute, near_copies

from tracewright.llm import jaccard_join as J


def test_repeated_rows_in_a_large_group(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = near_copies(3, base, 40, 9, 100)
    rows = rows + rows[::2] * 3 + [(7, "one row many times " * 9)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, own = [], J._compared
    monkeypatch.setattr(J, "_compared", lambda pairs, *a: seen.append((pairs.count(), pairs.select("a", "b").distinct().count())) or own(pairs, *a))
    got = sorted((tuple(r) for r in J.linked(docs, 3, 90, 8, 16).collect()), key=str)
    assert got == brute(rows, 3, 90)
    assert seen and all(rows == distinct for rows, distinct in seen)  # every pair is compared once


def test_one_id_with_several_texts_keeps_each(spark):
    rng = random.Random(1)
    text = lambda: " ".join(f"x{rng.randrange(9999)}" for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (3, c), (3, c.upper()), (4, ""), (4, None), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"] or 0, (r["text"] or "").lower()) for r in J.dedup_stage(spark, docs, "").collect()))
    assert got == [(0, c), (1, *[min(a, b)]), (1, max(a, b)), (3, c), (4, "")]


def test_hundreds_of_near_copies_and_long_texts(spark, monkeypatch):
    base = [f"w{i}" for i in range(70)]
    rows = near_copies(5, base, 120, 14, 100)  # many are not linked to their centre
    rng = random.Random(9)
    for i in range(40):  # copies of copies, cut and grown
        w = rows[rng.randrange(120)][1].split()
        at = rng.randrange(len(w))
        rows.append((400 + i, " ".join(w[:at] + w[at + rng.randrange(4) :] + [f"t{rng.randrange(9)}"] * rng.randrange(3))))
    long = [f"l{i % 3000}x{i}" for i in range(12000)]
    rows += near_copies(6, long, 4, 300, 600) + [(700 + i, " ".join(long[:40]) + f" own{i} " * 30) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen, own = [], J._around_centres
    monkeypatch.setattr(J, "_around_centres", lambda *a: seen.append(own(*a)) or seen[-1])
    for k, percent, direct in ((3, 90, J.DIRECT), (5, 80, 4)):
        monkeypatch.setattr(J, "DIRECT", direct)  # the small one takes the way around new centres
        got = sorted((tuple(r) for r in J.linked(docs, k, percent).collect()), key=str)
        assert got == brute(rows, k, percent), (k, percent)
    assert seen  # families were large enough for centres
