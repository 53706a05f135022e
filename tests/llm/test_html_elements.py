"""Which elements hold a page's text: comments, teasers, hidden and unclosed elements, implied ends, long and deep pages."""

import pytest

from tracewright.llm import html_extraction as H

A, M, O = H.ARTICLE, H.MARKED, H.OPEN


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # reader comments and teasers, in articles of their own
        ('<main><p>Body</p><section class="comments"><article class="comment"><h4>Al</h4><p>hi</p></article></section></main>', [("Body", A), ("Al hi", M)]),
        ('<article><p>Body</p></article><div id="comments"><article class="comment-body">hey</article><p>Leave a reply</p></div>', [("Body", A), ("hey Leave a reply", M)]),
        ('<article class="post"><p>Body</p></article><article class="comment-body">said much more than the body does</article>', [("Body", A), ("said much more than the body does", M)]),
        ('<aside><article>teaser</article></aside><article>Body</article><div class="related"><article>more and more and more</article></div>', [("teaser", M), ("Body", A), ("more and more and more", M)]),
        # marks of what the main article lies in do not count, those inside it do
        ('<form id="all"><div class="menu"><article>text<div class="share">s</div></article></div></form>', [("text", A), ("s", M)]),
        ("<aside><article>the only one</article></aside>", [("the only one", A)]),
        ("<p>much more text than the teaser beside it has</p><aside><article>teaser</article></aside>", [("much more text than the teaser beside it has", O), ("teaser", M)]),
        # ends that are left out
        ('<article><ul><li class="ad">buy<li>two</ul><p>after</p></article>', [("buy", M), ("two", A), ("after", A)]),
        ('<article><table><tr><td class="menu">m<td>cell<tr><td>x</table><p>after</article>', [("m", M), ("cell", A), ("x", A), ("after", A)]),
        ("<article><dl><dt>a<dd>b<dt>c</dl><p>d<p>e</article>", [("a", A), ("b", A), ("c", A), ("d", A), ("e", A)]),
        # ends that are missing
        ('<article><div class="ad">buy<p>stays</p>so does this</article>', [("buy", M), ("stays", A), ("so does this", A)]),
        ("<article><p>a</p><button>click<p>b</p>c</article>", [("a", A), ("b", A), ("c", A)]),
        ("<article><p>a</div>b</span>c</p></article>d", [("a", A), ("bc", A), ("d", O)]),
        ("<article><p><b>x<br><p>y</p><p>z</b></p></article>", [("x", A), ("y", A), ("z", A)]),
        # never shown
        ('<article><p>a</p><p hidden>h</p><div style="color:red; display: none"><p>n</p></div><p style="visibility:hidden">v</p><p data-hidden>b</p></article>', [("a", A), ("b", A)]),
        ("<article>a<script>var x = '<p>no</p>'</script><style>p{}</style><textarea><p>t</p></textarea>b</article>", [("ab", A)]),
        ("", []),
        (None, []),
        ("no markup &amp; none", [("no markup & none", O)]),
        ("<<>><article>&lt;p&gt; 1 < 2</article>", [("<<>>", O), ("<p> 1 < 2", A)]),
    ],
)
def test_regions(html, want):
    assert H.regions(html) == want


def test_long_and_deep_pages():
    body = "".join(f"<p>paragraph {i} of many</p>" for i in range(30_000))
    got = H.regions(f'<div class="nav">x</div><article>{body}</article>')
    assert len(got) == 30_001 and got[-1] == ("paragraph 29999 of many", A)
    deep = H.regions("<div>" * 5_000 + "inside" + "</div>" * 5_000)
    assert deep == [("inside", O)]


def test_comments_leave_and_the_array_still_decides_open_blocks(spark):
    note = "please sign up for our weekly letter and win a fine prize today"
    say = '<section class="comments"><article class="comment"><p>first! what a page this is</p></article></section>'
    rows = [(i, f"http://a.org/{i}", f"<div>{note}</div><main><p>body {i}</p></main>{say}<div>the rest of page {i} is in a plain element</div><div>{note} again and again</div>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS key", "3 AS text", "4 AS packed")
    got = {r["page_id"]: r["text"] for r in H.extracted(pages).collect()}
    # of four blocks outside the main article and the comments the array removes two on every page
    assert got == {i: f"body {i}\nthe rest of page {i} is in a plain element" for i in range(6)}
