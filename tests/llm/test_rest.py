"""Mixing, decontamination, HTML extraction and the pipeline's stages."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewright.llm import decontamination as D
from tracewright.llm import html_extraction as H
from tracewright.llm import mixing as M


def water_level(sizes, weights, times):
    """Targets by plain filling: give by weight, cap, share the rest again."""
    total, goal, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        step = {i: left * weights[i] / w for i in open_}
        full = {i for i in open_ if goal[i] + step[i] >= times * sizes[i]}
        if not full:
            for i in open_:
                goal[i] += step[i]
            break
        for i in full:
            left -= times * sizes[i] - goal[i]
            goal[i] = float(times * sizes[i])
        open_ -= full
        # the others start again from what is left for them
    return goal


def mix_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), rng.choice(["a", "b", "b", "c", None, "d", "e"])) for i in range(400)]
    rows += [(1000 + i, " ".join(["w"] * 50), "big") for i in range(300)] + [(5, "x y", "tiny"), (5, "x y", "tiny"), (None, "q", "a"), (7, None, "a"), (8, "", "zero")]
    return rows


def test_mix_meets_targets(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit(9)).withColumn("target", F.lit("x"))
    out = M.mixed(docs, rows_per_range=10).collect()
    assert len(out) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water_level([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    taken = {}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in names)
    again = M.mixed(docs.repartition(5), rows_per_range=10_000).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    mix = M.mix_stage(spark, docs.withColumn("n_chars", F.length("text").cast("long")), "")
    words = mix.select(F.sum(M.word_count(F.col("text"))).alias("w")).first()["w"]
    assert words == sum(taken.values()) and mix.columns == [*docs.columns, "n_chars"]


def test_mix_of_nothing(spark):
    assert M.mixed(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, c in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != c)))
        row = new
    return min(row)


def test_search_matches_full_alignment():
    rng = random.Random(6)
    letters = "abcdefghij klmno "
    item = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip() or "abcdefghijkl"
    items = [item(rng.choice([12, 30, 80, 200])) for _ in range(12)] + ["short", "", None]
    texts = []
    for i in range(60):
        t, p = item(rng.choice([0, 50, 400])), list(items[rng.randrange(12)])
        for _ in range(rng.choice([0, 0, 1, 3, len(p) // 10, len(p) // 5])):
            at = rng.randrange(len(p))
            p[at : at + 1] = rng.choice([[], ["z"], [p[at], "y"]])
        texts.append(t + " " + ("".join(p) if i % 3 else "") + "\n " + item(30))
    index = D.Index(list(range(len(items))), items)
    found = {(t, i): e for t, i, e, _ in index.search(pa.array([*texts, None, ""]))}
    norm, bounds = D.normalised(pa.array(texts))
    for t in range(len(texts)):
        whole = norm[bounds[t] : bounds[t + 1] - 1].tobytes()
        for j, own in enumerate(index.items):
            e, budget = edits(own.tobytes(), whole), int(index.budget[j])
            assert found.get((t, index.ids[j])) == (e if e <= budget else None), (t, j, e, budget)


def test_decontamination_on_odd_rows(spark):
    passage = "this is a passage of a benchmark that nobody should train on at all"
    rows = [(1, None), (2, ""), (3, "x " * 3000 + passage.upper() + " y" * 3000), (3, passage), (None, f"a {passage}"), (4, "clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, passage), (8, None), (9, "")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in D.leaks(docs, bench).collect())
    assert got == [("3", 7, 0), ("3", 7, 0), ("None", 7, 0)]
    assert D.leaks(docs.limit(0), bench).collect() == [] and D.leaks(docs, bench.limit(0)).collect() == []


def test_blocks_drop_boilerplate():
    html = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>
    <div class="cookie-notice"><p>We use</p></div><article><h1>Head &amp; tail</h1><p>One <b>two
    three</b><br>four<p>five<aside>see also</aside><form><input value=">">name</form><div class="comments"><p>first!</div><p>six &#233;&nbsp;x</article>
    <script>if(a<b){"</p>"}</script><div id="sidebar">more</div><!-- <p>gone</p> --><footer>&copy; me</footer></body></html>"""
    got = H.blocks(html)
    assert [t for t, inside in got if inside] == ["Head & tail", "One two three four", "five", "six é x"]
    assert [t for t, inside in got if not inside] == []
    assert H.blocks(None) == [] and H.blocks("") == [] and H.blocks("a < b <3 c") == [("a < b <3 c", False)]
    assert H.blocks("<div>a<!-- never closed") == [("a", False)]


def test_host_suffixes(spark):
    note = "please sign up for our weekly letter and win a fine prize today"
    rows = [(i, f"http://{'a' if i < 4 else 'b'}.org/{i}", f"<body><div>{note}</div><div>own words number {i} of this page are only here {i}</div></body>") for i in range(5)]
    rows += [(9, "http://a.org/x", f"<article><p>{note}</p></article>"), (10, None, None), (10, None, ""), (11, "http://c.org", "<div>same text on a page of eight or more words</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("row", F.lit(2))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in H.extracted(pages).collect())
    want = [(i, f"own words number {i} of this page are only here {i}") for i in range(4)] + [(4, f"{note}\nown words number 4 of this page are only here 4"), (9, note), (10, ""), (10, ""), (11, "same text on a page of eight or more words")]
    assert got == [(i, t, len(t)) for i, t in want]
    assert H.extracted(pages.limit(0)).collect() == []


def test_pipeline_stages_are_five():
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
    assert np.unique([n for n, _ in corpus_pipeline.STAGES]).size == 5
