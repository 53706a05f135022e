"""Edge cases and held-out accuracy of the scoring operators."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import language_model as LM
from tracewright.llm import licenses, quality_classifier, quality_rules, toxicity

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "y z " * 4000), (None, "some words here"), (7, "same same\nsame same\n\nsame same"), (7, "same same\nsame same\n\nsame same"), (8, "É ß 漢字 #*$%&|<>")]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with the operators' own names."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("a")).withColumn("held_out", F.lit(2)).withColumn("n", F.lit(3))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_base_counts_match_plain_python():
    texts = [t for _, t in ODD] + ["a b c a b c d", "#x# <y>\n#x# <y>\n \n \n#x# <y> ", "a b a b a b", "one two"]
    got = quality_rules.base_counts(pa.array(texts))
    for i, text in enumerate(texts):
        w = words(text)
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        cover = {j + d for j, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)} if len(w) < 500 else set(range(len(w)))
        rows = [x for x in (text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum((text or "").count(c) for c in quality_rules.SYMBOLS), sum(x in rows[:j] for j, x in enumerate(rows)), len(cover))
        assert tuple(got[k][i] for k in quality_rules._COLUMNS) == want, text


def test_ngrams_stay_inside_texts():
    texts = ["abcdef", "", "ab", "abcdx", None, "bcde"]
    from tracewright.llm import _text

    code, bounds = quality_rules.ngrams(*_text.encoded(pa.array(texts)))
    assert np.diff(bounds).tolist() == [max(0, len(t or "") - 3) for t in texts]
    assert code[0] == code[bounds[3]] and code[1] == code[bounds[5]]


def test_quality_rules_keep_clean_and_drop_noise(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(900)) for _ in range(80))) for i in range(60)]
    noise = [(100 + i, " ".join(f"{rng.choice('qxz')}{rng.randrange(99)}$$$%%%" for _ in range(80))) for i in range(20)]
    docs = spark.createDataFrame(clean + noise, "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.scored(docs, quality_rules.fit(docs)).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in noise)


def test_toxicity_grades_and_thresholds(spark):
    rng = random.Random(2)
    bad = ["vilex", "grubox", "snarlik"]
    rows, labels = [], []
    for i in range(300):
        w = [f"w{rng.randrange(300)}" for _ in range(40)]
        n = rng.randrange(1, 6) if i % 3 == 0 else 0
        for _ in range(n):
            w[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", "s", "ed", "."])
        rows.append((i, " ".join(w)))
        labels.append((i, int(n > 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:200], "doc_id long, toxic int"))
    assert (np.diff(model.thresholds) >= 0).all() and (model.weights >= 0).all()
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    truth = dict(labels)
    assert np.mean([got[i]["toxic"] == bool(truth[i]) for i in range(200, 300)]) > 0.95
    assert all(0 <= r["severity"] <= 3 for r in got.values())
    one, four = (toxicity.probabilities(pa.array([" ".join(["vilex"] * n + ["w1"] * 9)]), model).sum() for n in (1, 4))
    assert four > one


def test_quality_classifier_held_out_accuracy(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        good = i % 2
        w = [rng.choice(["la", "mo", "ri", "ten"]) + rng.choice(["na", "do", "s"]) + ("" if good else rng.choice(["!!", "@@"])) for _ in range(50)]
        rows.append((i, " ".join(w)))
        labels.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality_classifier.scored(docs, quality_classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_license_alignment_needs_the_phrase(spark):
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "obtaining documentation associated person charge granted hereby permission",
        "Licensed under CC BY-NC 4.0.",
        "x MIT License y Apache License z general public license mit license",
        "redistribution and use in source forms with modification are permitted",
        None,
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(50 + i, f"plain words of text {i} and more of them") for i in range(50)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scored(docs, licenses.idf(docs)).collect()}
    assert got[0]["labels"] == "mit" and got[0]["base_labels"] == "" and got[0]["score"] > 0.9
    assert got[1]["labels"] == "" and got[4]["labels"] == "" and got[2]["labels"] == "cc-by-nc"
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["base_labels"]) == (4, 1, 10, "apache,gpl,mit")
    assert (got[5]["n_words"], got[5]["first_word"], got[5]["labels"], got[5]["score"]) == (0, None, "", 0.0)


def test_recursions_match_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    k, s = 3, 5
    m = LM.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T)
    seqs = [rng.integers(0, s, n) for n in (1, 4, 2, 5, 1)]
    flat, bounds = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(x) for x in seqs])])
    total, starts, moves, emissions = [], np.zeros(k), np.zeros((k, k)), np.zeros((s, k))
    for x in seqs:
        paths = []
        for z in itertools.product(range(k), repeat=len(x)):
            p = m.start[z[0]] * math.prod(m.move[z[i - 1], z[i]] for i in range(1, len(x))) * math.prod(m.emit[x[i], z[i]] for i in range(len(x)))
            paths.append((z, p))
        whole = sum(p for _, p in paths)
        total.append(math.log10(whole))
        for z, p in paths:
            starts[z[0]] += p / whole
            for i in range(len(x)):
                emissions[x[i], z[i]] += p / whole
            for i in range(1, len(x)):
                moves[z[i - 1], z[i]] += p / whole
    assert np.allclose(LM.log_likelihood(flat, bounds, m), total)
    for got, want in zip(LM.expected_counts(flat, bounds, m), (starts, moves, emissions), strict=True):
        assert np.allclose(got, want)


def test_language_model_base_is_exact_for_any_head(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"W{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60)))) for i in range(80)] + [r for r in ODD if r[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = {}
    for d, t in rows:
        if not held(d):
            for w in [*words(lower(t)), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((d, len(words(t)) + 1, sum(w in counts for w in [*words(lower(t)), None]), round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*words(lower(t)), None]), 6)) for d, t in rows)
    for head in (0, 7, 1000):
        got = LM.language_model(docs, head=head, rounds=1).collect()
        assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["train_tokens"] == n and r["held_out"] == held(r["doc_id"]) and r["score"] < 0 for r in got)


@pytest.mark.parametrize("make", [odd, empty])
def test_odd_and_empty_tables(spark, make):
    docs = make(spark)
    n = docs.count()
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (8, 1, None), (99, None, 1)], "doc_id long, quality int, toxic int")
    frames = [
        quality_rules.scored(docs, quality_rules.fit(docs)),
        toxicity.scored(docs, toxicity.fit(docs, labels)),
        quality_classifier.scored(docs, quality_classifier.fit(docs, labels)),
        licenses.scored(docs, licenses.idf(docs)),
        LM.language_model(docs, rounds=1),
    ]
    for df in frames:
        assert df.count() == n
        if n:
            assert sorted(str(r["doc_id"]) for r in df.select("doc_id").collect()) == sorted(str(d) for d, _ in ODD)
