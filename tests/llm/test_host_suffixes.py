"""The host suffix array against repeats found by comparing every start with all pages."""

import random

import pyarrow as pa

from tracewright.llm import html_extraction as H


def longest_repeats(streams, least):
    """For each (page, start): the longest run from there, RUN tokens or more, that is on ``least`` pages; the covered tokens."""
    out = {}
    for page, words in streams.items():
        covered = [False] * len(words)
        for at in range(len(words)):
            n = H.RUN
            while at + n <= len(words) and sum(any(o[j : j + n] == words[at : at + n] for j in range(len(o) - n + 1)) for o in streams.values()) >= least:
                n += 1
            if n > H.RUN:
                covered[at : at + n - 1] = [True] * (n - 1)
        out[page] = covered
    return out


def test_removed_blocks_are_those_that_longest_repeats_cover(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    phrase = [[rng.choice(words) for _ in range(n)] for n in (8, 14, 25, 5)]
    rows, want = [], {}
    for host, count in (("a", 9), ("b", 6), ("c", 4)):
        pages = {}
        for i in range(count):
            parts = []
            for _ in range(rng.randrange(2, 7)):
                kind = rng.choice([H.OPEN, H.OPEN, H.ARTICLE, H.MARKED])
                text = rng.choice(phrase) if rng.random() < 0.85 else [rng.choice(words) for _ in range(rng.randrange(1, 30))]
                if rng.random() < 0.3:
                    text = text + rng.choice(phrase)
                parts.append((kind, text))
            parts.append((H.OPEN, [f"own{host}{i}"] * 3))
            tag = {H.OPEN: "div", H.ARTICLE: "article", H.MARKED: "footer"}
            rows.append((len(rows), f"http://{host}.org/{i}", "".join(f"<{tag[k]}>{' '.join(t)}</{tag[k]}>" for k, t in parts)))
            pages[rows[-1][0]] = parts
        least = max(H.PAGES, -(-len(pages) // 2))
        covered = longest_repeats({p: [w for k, t in parts if k != H.ARTICLE for w in t] for p, parts in pages.items()}, least)
        for p, parts in pages.items():
            at, left = 0, []
            for k, t in parts:
                n = 0 if k == H.ARTICLE else len(t)
                if k == H.ARTICLE or (k == H.OPEN and not all(covered[p][at : at + n])):
                    left.append(" ".join(t))
                at += n
            want[p] = ("\n".join(left), sum(covered[p]))
    got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and sum(n > 0 for _, n in want.values()) > len(want) / 2


def test_ranges_of_sorted_suffixes_count_each_page_once():
    streams = pa.record_batch({"host": pa.array([1, 1, 1, 2]), "page": pa.array([5, 6, 6, 5]), "stream": pa.array([" ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(10)) * 2, " ".join(f"w{i}" for i in range(12)), " ".join(f"w{i}" for i in range(12))])})
    table = pa.Table.from_batches(H._suffixes([streams])).sort_by([("host", "ascending"), ("key", "ascending"), ("page", "ascending")])
    for size in (1, 3, 100):
        total = {}
        for batch in H._neighbours(table.combine_chunks().to_batches(max_chunksize=size)):
            for r in batch.to_pylist():
                total[r["host"], r["suffix"]] = total.get((r["host"], r["suffix"]), 0) + r["pages"]
        names = {(r["host"], r["suffix"]) for b in H._places([streams.append_column("key", pa.array([bytes([i]) for i in range(4)]))]) for r in b.to_pylist()}
        assert set(total) == names and max(total.values()) == 2 and sum(n == 2 for n in total.values()) == 5


def test_marked_text_is_evidence_but_no_text(spark):
    note = "please sign up for our weekly letter and win a fine prize today"
    rows = [(i, f"http://a.org/{i}", f"<article>text {i}</article><footer>{note}</footer>") for i in range(3)]
    rows.append((9, "http://a.org/9", f"<div>{note}</div><article>text 9</article><span class='ad'>buy</span>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, H.extracted(pages).select("page_id", "text", "n_repeated").collect())) == [(i, f"text {i}", 13) for i in (0, 1, 2, 9)]
    assert H.regions(f"a<span class='ad'>buy <b>now</b></span> b<nav><a>x</a><a>y</a></nav><p>c") == [("buy now", H.MARKED), ("a b", H.OPEN), ("x y", H.MARKED), ("c", H.OPEN)]


def test_suffixes_do_not_pass_the_driver(spark):
    """Parts and places grow with the pages: no broadcast has them."""
    menu = " ".join(f"menu{i}" for i in range(20))
    rows = [(i, f"http://h.example/{i}", f"<nav>{menu}</nav><article><p>text {i} of its own</p></article>") for i in range(8)]
    found = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["n_repeated"] for r in found.collect()} == {20}
    plan, inside = found._jdf.queryExecution().executedPlan().toString().split("\n"), None
    assert any("Generate" in line for line in plan)
    for line in plan:
        depth = len(line) - len(line.lstrip(" :+-*"))
        if inside is not None and depth <= inside:
            inside = None
        if "BroadcastExchange" in line and inside is None:
            inside = depth
        assert inside is None or not ("Generate" in line or "collect_set" in line), line
