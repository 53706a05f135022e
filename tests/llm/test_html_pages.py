"""HTML extraction: what tags decide and what a host's pages decide."""

from tracewright.llm import html_extraction as H


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in H.extracted(pages).collect()}


def test_wrappers_of_an_article_are_not_skipped():
    for wrapper in ('<form id="aspnetForm">', '<div class="menu">', '<div class="page has-sidebar no-comments">', '<aside><div class="ad">'):
        name = wrapper[1:].split(" ")[0].split(">")[0]
        got = H.blocks(f"<body>{wrapper}<div>before</div><article><p>the text</p></article></div></{name}><footer>f</footer></body>")
        assert got == [("before", False), ("the text", True)], wrapper
    assert H.blocks("<head><title>t</title><article>no body tag</article>") == [("no body tag", True)]
    assert H.blocks('<p class="ad">buy<article>text</article>') == [("text", True)]
    assert H.blocks('<div class="cookie-notice">a</div><div class="AD top">b</div><div class="adds shared">c</div>') == [("c", False)]


def test_blocks_outside_an_article_are_judged_by_the_host(spark):
    note = "please sign up for our weekly letter and win a fine prize today"
    rows = [(i, f"http://a.org/{i}", f"<div>{note}</div><article>teaser {i}</article><div>the body of page {i} is in a plain element</div>") for i in range(6)]
    assert texts(spark, rows) == {i: f"teaser {i}\nthe body of page {i} is in a plain element" for i in range(6)}


def test_copied_pages_keep_their_text(spark):
    page = lambda i, n=60: "<div>" + " ".join(f"w{i}x{j}" for j in range(n)) + "</div>"
    near = page(1, 300).replace("w1x150", "other")
    quote = "<blockquote>to be or not to be that is the question</blockquote>"
    rows = [(1, "http://a.org/1", page(1)), (1, "http://a.org/1", page(1)), (2, "http://a.org/2", page(1)), (3, "http://a.org/3", page(1))]
    rows += [(10 + i, f"http://b.org/{i}", page(1, 300) if i % 2 else near) for i in range(6)]
    rows += [(20 + i, f"http://c.org/{i}", page(20 + i) + (quote if i < 2 else "")) for i in range(5)]
    rows += [(30 + i, None, f"<div>the same text of eight words or more here</div>{page(30 + i)}") for i in range(4)]
    got = texts(spark, rows)
    for i, _, html in rows:
        assert got[i].split() == [w for t, _ in H.blocks(html) for w in t.split()], i


def test_copies_of_a_page_do_not_hide_boilerplate(spark):
    note = "please sign up for our weekly letter and win a fine prize today"
    rows = [(i, f"http://a.org/{i}", f"<div>{note}</div><div>" + " ".join(f"w{max(i, 5)}x{j}" for j in range(40)) + f" {note}</div>") for i in range(2, 20)]
    own = [(40 + i, f"http://b.org/{i}", f"<div>{note}</div><div>" + " ".join(f"w{max(i, 5)}x{j}" for j in range(40)) + f" {note}</div>") for i in range(20)]
    got = texts(spark, rows + own)
    assert all(t.startswith("w") and t.endswith(note) for t in got.values())
