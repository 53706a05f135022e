import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.llm import jaccard_join as J


def sets(rows, k):
    out = []
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((doc, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    return out


def brute(rows, k, percent):
    """Components by all pairs."""
    own = sets(rows, k)
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(own):
        for j in range(i):
            b = own[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(own):
        if doc is not None:
            groups.setdefault(find(i), []).append(doc)
    return sorted(((doc, len(s), min(groups[find(i)]) if doc is not None else None) for i, (doc, s) in enumerate(own)), key=str)


def near_copies(seed, base, copies, most_edits, first):
    rng = random.Random(seed)
    rows = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, most_edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(200)}"
        rows.append((first + i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "percent", "words"), [(3, 90, 120), (5, 80, 40)])
def test_groups_of_near_copies_match_all_pairs(spark, k, percent, words):
    rng = random.Random(words)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = near_copies(1, base, 60, 6, 100) + [(500 + i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(40))) for i in range(15)]
    rows += near_copies(2, [f"v{rng.randrange(99)}" for _ in range(words // 2)], 25, 3, 900) + [(50, " ".join(base)), (51, " ".join(base).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, k, percent)
    for frequent, large in ((2, 3), (8, 16)):
        got = sorted((tuple(r) for r in J.linked(docs, k, percent, frequent, large).collect()), key=str)
        assert got == want, (frequent, large)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (5, "ONE"), (6, "a b"), (7, "a b c"), (None, "a b c"), (None, "zz"), (8, "x " * 5000), (9, "x " * 5001), (9, "other words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("n", F.lit(2))
    got = sorted((tuple(r) for r in J.linked(docs, 3, 90).collect()), key=str)
    assert (1, 0, 1) in got and (3, 0, 3) in got and (5, 1, 4) in got and got.count((5, 1, 4)) == 2 and (6, 1, 6) in got and (9, 1, 8) in got
    assert len(got) == len(rows)
    kept = J.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8, 9]


def test_empty_table(spark):
    assert J.linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def moved(spark) -> int:
    """MB that all stages so far have written to shuffles."""
    none = spark._jvm.java.util.ArrayList
    stages = spark._jsc.sc().statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6


def test_texts_that_link_with_nothing_do_not_move(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.getrandbits(80):x}" for _ in range(60))) for i in range(3000)]  # 3.8 MB that no compression makes small
    rows += [(3000 + i, t + " end") for i, (_, t) in enumerate(rows[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved(spark)
        kept = sorted(r["doc_id"] for r in J.dedup_stage(spark, docs, "").select("doc_id", "text").collect())
        assert kept == list(range(3000))
        assert moved(spark) - before < 3  # 1.3 MB of tokens, a few texts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
