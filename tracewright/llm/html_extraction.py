"""HTML extraction with a host suffix array.

Pages are cut into blocks of three kinds. Blocks inside the article (``article``, ``main``) are its
text. Marked boilerplate (menus, footers, adverts, forms, comments and so on) goes, unless the main
article lies in it, and so does hidden text. Open blocks, which are outside the article and not marked, may be either.

The token streams of all that is outside the articles, marked or open, are laid end to end. Their
suffixes, to a depth of ``RUN`` tokens, are sorted by host over ranges, and equal neighbours are
counted: a suffix on ``SHARE`` of the host's distinct pages with open blocks, ``PAGES`` at least,
begins a repeated run. An open block that such runs cover whole goes, be its copies on other pages
marked or open; all others stay whole, in page order. A deeper order would say no more: a longer
repeat covers the same tokens as all its windows of ``RUN``, which are repeated on the same pages.
``n_repeated`` counts the words outside a page's article that repeated runs cover.

Equal pages of a host count as one page, else a copied page would look like boilerplate; so do near
copies (``ALIKE`` percent of their windows, by the exact join of ``jaccard_join``) among pages with
open blocks, which alone can lose text.

Passages that articles of one host share are text, not boilerplate, so the suffix array does not
hold blocks inside an article.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _text
from tracewright.llm._store import kept
from tracewright.llm.jaccard_join import linked

#: Tokens that a repeated substring has at least.
RUN = 8
#: Boilerplate is on so many pages of its host at least ...
PAGES = 3
#: ... and on this share of its distinct pages that have open blocks.
SHARE = 0.5
#: A suffix that many pages share is joined to these in so many parts.
PARTS = 16
#: Pages of a host are one if this percentage of their windows of RUN words is the same.
ALIKE = 90

#: Elements whose text is never shown or never prose.
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option datalist textarea button".split())
#: Elements that are boilerplate by themselves.
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
#: Words of class, id and role that mark boilerplate.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead contentinfo complementary search social share sharing related recommended comment comments commentlist reply replies disqus popup modal overlay copyright legal login toolbar pagination pager skip".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Kinds of blocks.
OPEN, ARTICLE, MARKED = 0, 1, 2
#: Elements whose content is not markup.
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))

#: Elements whose end tag may be left out, and what ends them: the next of a kind, up to their holder.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
OPTIONAL = frozenset([*IMPLIED, "p", "body", "html", "head", "caption", "colgroup"])
#: An end tag does not reach beyond these.
WALLS = frozenset("html table td th caption".split())
#: Words that mark what readers and machines add to an article; an article with one is none.
SECONDARY = frozenset("comment comments commentlist reply replies respond disqus related recommended teaser teasers".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|style\s*=\s*(?:\"[^\"]*?|'[^']*?|)(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.I)
_PART = re.compile(r"[-_]+")


def _tokens(attributes: str) -> list[list[str]]:
    """The words of each token of class, id and role."""
    return [_PART.split(t.strip("-_")) for m in _MARK.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split()]


def blocks(html: str | None) -> list[tuple[str, bool]]:
    """The text of each block in page order and whether it is inside an article; boilerplate is left out."""
    return [(text, kind == ARTICLE) for text, kind in regions(html) if kind != MARKED]


class _Page:
    """The elements of a page, each after its parent, and its texts and block edges in order.

    End tags that are left out are implied: by the next element of a kind (``IMPLIED``), by a block
    (of a paragraph and of the head), and by the end of a parent. An end tag without a start, or of an inline
    element around a block, ends nothing.
    """

    def __init__(self, html: str):
        self.names, self.parents, self.attributes = ["#page"], [0], [""]
        self.ended, self.first_block, self.first_text = [True], [0], [0]
        self.texts: list[tuple[int, str | None]] = []  # the element it is in, and the text; None is an edge
        self.stack, self.open = [0], {}
        at = 0
        while m := _TAG.search(html, at):
            if m.start() > at:
                self.texts.append((self.stack[-1], html[at : m.start()]))
            at = m.end()
            end, name, attributes = m[1], (m[2] or "").lower(), m[3] or ""
            if not name:
                continue
            if name in BLOCKS:
                self.texts.append((self.stack[-1], None))
            if end:
                self._end(name)
                if name in BLOCKS:
                    self.texts.append((self.stack[-1], None))
                continue
            self._imply(name)
            if name in VOID or attributes.endswith("/"):
                if name == "br":
                    self.texts.append((self.stack[-1], " "))
                continue
            self._start(name, attributes)
            if name in RAW:
                at = _after(html, at, name)
                self._pop(True)
        if at < len(html):
            self.texts.append((self.stack[-1], html[at:]))

    def _start(self, name: str, attributes: str) -> None:
        parent = self.stack[-1]
        if name in BLOCKS and not self.first_block[parent]:
            self.first_block[parent], self.first_text[parent] = len(self.names), len(self.texts)
        self.stack.append(len(self.names))
        self.open[name] = self.open.get(name, 0) + 1
        self.names.append(name)
        self.parents.append(parent)
        self.attributes.append(attributes)
        self.ended.append(name in OPTIONAL)
        self.first_block.append(0)
        self.first_text.append(0)

    def _pop(self, ended: bool) -> str:
        i = self.stack.pop()
        self.ended[i] |= ended
        self.open[self.names[i]] -= 1
        return self.names[i]

    def _imply(self, name: str) -> None:
        if self.open.get("head") and (name == "body" or name in BLOCKS):
            while self._pop(True) != "head":
                pass
        if name in BLOCKS and self.open.get("p"):
            for depth in range(len(self.stack) - 1, 0, -1):
                inside = self.names[self.stack[depth]]
                if inside == "p":
                    while len(self.stack) > depth:
                        self._pop(False)
                    break
                if inside in BLOCKS or inside == "button":
                    break
        if name in IMPLIED:
            ends, holders = IMPLIED[name]
            last = 0
            for depth in range(len(self.stack) - 1, 0, -1):
                inside = self.names[self.stack[depth]]
                if inside in holders:
                    break
                if inside in ends:
                    last = depth
            while last and len(self.stack) > last:
                self._pop(False)

    def _end(self, name: str) -> None:
        if not self.open.get(name):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            inside = self.names[self.stack[depth]]
            if inside == name:
                while len(self.stack) > depth + 1:
                    self._pop(False)
                self._pop(True)
                return
            if inside in WALLS and name not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html") or (inside in BLOCKS and name not in BLOCKS) or (name == "li" and inside in ("ul", "ol", "menu")):
                return


def regions(html: str | None) -> list[tuple[str, int]]:
    """The text of each block in page order and its kind; a marked element is one block.

    The main article is the ``article`` or ``main`` with the most text that is neither hidden, marked, nor inside
    comments, related links or an aside; only if there is none and no more text elsewhere, one of those. What
    it lies in is no boilerplate, whatever its marks; all else that is marked goes, with articles in it.
    A marked element that its own tag does not end, and whose end may not be left out, ends where its
    first block begins: it does not swallow what follows.
    """
    page = _Page(html or "")
    names, parents, texts = page.names, page.parents, page.texts
    n = len(names)
    hidden, own, beside, article = [False] * n, [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        name, attributes = names[i], page.attributes[i]
        words = _tokens(attributes) if attributes else []
        own[i] = name not in ("body", "html") and (name in BOILERPLATE or any(all(w in MARKS for w in t) for t in words))
        hidden[i] = name in HIDDEN or name == "title" or (bool(attributes) and name not in ("body", "html") and bool(_UNSEEN.search(attributes)))
        beside[i] = name in ("aside", "nav", "footer") or any(all(w in MARKS for w in t) and any(w in SECONDARY for w in t) for t in words) or (name == "article" and any(w in SECONDARY for t in words for w in t))
    # an element that nothing ends stops where its first block begins
    cut = {i: page.first_block[i] for i in range(1, n) if not page.ended[i] and page.first_block[i] and (own[i] or hidden[i])}
    for i in range(1, n):
        while parents[i] in cut and i >= cut[parents[i]]:
            parents[i] = parents[parents[i]]
        up = parents[i]
        hidden[i] |= hidden[up]
        beside[i] |= beside[up]
        article[i] = article[up] or names[i] in ("article", "main")
    if cut:
        moved = []
        for at, (i, t) in enumerate(texts):
            while i in cut and at >= page.first_text[i]:
                i = parents[i]
            moved.append((i, t))
        texts = moved
    size = [0] * n
    for i, t in texts:
        size[i] += len(t) if t else 0
    total = list(size)
    for i in range(n - 1, 0, -1):
        if not hidden[i] and not own[i]:
            size[parents[i]] += size[i]
        if not hidden[i]:
            total[parents[i]] += total[i]
    articles = [i for i in range(1, n) if names[i] in ("article", "main") and not hidden[i]]
    main = max((i for i in articles if not beside[i] and not own[i]), key=lambda i: size[i], default=0)
    if not main and articles:
        best = max(articles, key=lambda i: size[i])
        main = best if 2 * total[best] >= total[0] else 0
    spared = set()
    i = main
    while i:
        spared.add(i)
        i = parents[i]
    root = [0] * n  # the marked element that an element lies in
    for i in range(1, n):
        up = parents[i]
        mine = own[i] or (names[i] == "header" and not article[i]) or (names[i] == "article" and beside[i] and i != main)
        root[i] = root[up] or (i if mine and i not in spared else 0)
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    said: list[str] = []  # of the marked element that is open
    kind, mark = OPEN, 0

    def flush(texts: list[str], kind: int) -> None:
        text = " ".join(_html.unescape((" " if kind == MARKED else "").join(texts)).split())  # a menu's links stay apart
        texts.clear()
        if text:
            out.append((text, kind))

    for i, t in texts:
        if hidden[i]:
            continue
        if mark and root[i] != mark:
            flush(said, MARKED)
        mark = root[i]
        if mark:  # one within a line does not end the block around it
            said.append(" " if t is None else t)
            continue
        here = ARTICLE if article[i] else OPEN
        if here != kind or t is None:
            flush(parts, kind)
            kind = here
        if t is not None:
            parts.append(t)
    flush(said, MARKED)
    flush(parts, kind)
    return out


def _after(html: str, at: int, name: str) -> int:
    """The end of a raw element's closing tag."""
    m = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
    return m.end() if m else len(html)


def _host(url) -> F.Column:
    """The host in lower case, without user and port; without one, empty."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _sources(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host and ``key``: rows of one key have the same host and html."""
    host = _host(F.col("url"))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host")).withColumn("key", F.unhex(F.md5(F.concat("host", F.lit("\n"), "html"))))


def _streams(batches):
    """What is outside the articles, of pages that have any; with open blocks, also all text."""
    for piece in _text.slices(batches, "html"):
        rows = []
        for key, host, html in zip(*(piece.column(c).to_pylist() for c in ("key", "host", "html")), strict=True):
            found = regions(html)
            stream = "\n".join(t for t, k in found if k != ARTICLE)
            if stream:
                text = "\n".join(t for t, k in found if k != MARKED)
                page = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)
                is_open = any(k == OPEN for _, k in found)
                rows.append((key, host, page, is_open, text if is_open else None, stream))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _STREAM.values())] if rows else [pa.array([], t) for t in _STREAM.values()], list(_STREAM))


_STREAM = {"key": pa.binary(), "host": pa.int64(), "page": pa.int64(), "open": pa.bool_(), "text": pa.string(), "stream": pa.string()}


def _packed(batches):
    """The blocks of each page, compressed for the shuffle: their kinds, then a line for each; of marked blocks the number of words."""
    for piece in _text.slices(batches, "html"):
        out = []
        for html in piece.column("html").to_pylist():
            found = regions(html)
            lines = ["".join(str(k) for _, k in found), *(str(len(t.split())) if k == MARKED else t for t, k in found)]
            out.append(zlib.compress("\n".join(lines).encode(), 1))
        yield pa.record_batch({"page_id": piece.column("page_id"), "url": piece.column("url"), "key": piece.column("key"), "packed": pa.array(out, pa.binary())})


def _keys(piece):
    """The suffixes of each page: RUN tokens as big-endian 32-bit fingerprints, the page's index, the place in its stream."""
    words, first = _text.word_hashes(piece.column("stream"), lower=False)
    n = np.maximum(np.diff(first) - RUN + 1, 0)
    at = np.concatenate([[0], np.cumsum(n)])
    owner = _text.owners(at)
    place = np.arange(at[-1]) - at[owner]
    tokens = (words >> np.uint64(32)).astype(">u4")
    return tokens[(first[:-1][owner] + place)[:, None] + np.arange(RUN)], owner, place


def _names(keys: np.ndarray) -> np.ndarray:
    """A 64-bit name of each suffix key."""
    wide = np.ascontiguousarray(keys).view(">u8").astype(np.uint64).reshape(len(keys), -1)
    total = np.zeros(len(keys), np.uint64)
    for column in wide.T:
        total = _text.mix(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total.view(np.int64)


def _suffixes(batches):
    """Rows to sort: host, suffix key, page."""
    for piece in _text.slices(batches, "stream"):
        keys, owner, _ = _keys(piece)
        width = 4 * RUN
        offsets = pa.array(np.arange(len(keys) + 1) * width, pa.int32()).buffers()[1]
        key = pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, pa.py_buffer(keys.tobytes())])
        take = pa.array(owner)
        yield pa.record_batch({"host": piece.column("host").take(take), "key": key, "page": piece.column("page").take(take)})


def _places(batches):
    """Rows to look up: host, suffix name, key, place."""
    for piece in _text.slices(batches, "stream"):
        keys, owner, place = _keys(piece)
        take = pa.array(owner)
        yield pa.record_batch({"host": piece.column("host").take(take), "suffix": pa.array(_names(keys)), "key": piece.column("key").take(take), "place": pa.array(place, pa.int32())})


def _neighbours(batches):
    """Of sorted suffixes: each suffix and the pages it is on, as far as this range knows; a page is in one range only."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        data, _ = _text.encoded(batch.column("key"))
        keys = data.reshape(batch.num_rows, 4 * RUN)
        host, page = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("host", "page"))
        before = last or (None, None, None)
        group, other = np.ones(len(host), bool), np.ones(len(host), bool)
        group[1:] = (host[1:] != host[:-1]) | (keys[1:] != keys[:-1]).any(1)
        other[1:] = group[1:] | (page[1:] != page[:-1])
        if last and before[0] == host[0] and before[1] == keys[0].tobytes():
            other[0] = before[2] != page[0]
        last = host[-1], keys[-1].tobytes(), page[-1]
        starts = np.flatnonzero(group)
        yield pa.record_batch({"host": pa.array(host[starts]), "suffix": pa.array(_names(keys[starts])), "pages": pa.array(np.add.reduceat(other.astype(np.int64), starts))})


def repeated(streams: DataFrame) -> DataFrame:
    """``host, suffix, pages`` of suffixes on ``PAGES`` pages at least, of ``streams(host, page, stream)``.

    Suffixes are sorted over ranges by host, key and page, so one that is on very many pages is
    dealt over several ranges, whose counts are added.
    """
    order = ("host", "key", "page")
    # as many ranges as the session's shuffles have; without a number, AQE may join small ones
    array = streams.select("host", "page", "stream").mapInArrow(_suffixes, "host long, key binary, page long").repartitionByRange(*order).sortWithinPartitions(*order)
    return array.mapInArrow(_neighbours, "host long, suffix long, pages long").groupBy("host", "suffix").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= PAGES)


def _uncovered(batches):
    """The article and the open blocks that repeated runs do not cover whole."""
    for batch in batches:
        out, count = [], []
        for packed, places in zip(batch.column("packed").to_pylist(), batch.column("places").to_pylist(), strict=True):
            kinds, *texts = zlib.decompress(packed).decode().split("\n")
            kinds = [int(k) for k in kinds]
            size = [0 if k == ARTICLE else int(t) if k == MARKED else len(t.split()) for t, k in zip(texts, kinds, strict=True)]
            covered = np.zeros(sum(size) + RUN, bool)
            for p in places or []:
                covered[p : p + RUN] = True
            at, left = 0, []
            for n, kind, t in zip(size, kinds, texts, strict=True):
                if kind == ARTICLE or (kind == OPEN and not covered[at : at + n].all()):
                    left.append(t)
                at += n
            out.append("\n".join(left))
            count.append(int(covered.sum()))
        yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string()), "n_repeated": pa.array(count, pa.int64())})


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_repeated`` of every row of ``pages(page_id, url, html, ...)``.

    A null or empty html gives an empty text. Nothing is known of the pages beside a page without
    a host: all its open blocks stay. Repeated rows each get a row, and count as one page. Other
    columns are ignored.
    """
    source = _sources(pages)
    id_type = source.schema["page_id"].dataType.simpleString()
    hosted = source.where("host <> ''").select("key", F.xxhash64("host").alias("host"), "html")
    streams = kept(hosted.mapInArrow(_streams, "key binary, host long, page long, open boolean, text string, stream string"), "streams")
    open_ = streams.where("open")
    if not open_.isEmpty():
        alike = linked(open_.select(F.col("page").alias("doc_id"), "text"), RUN, ALIKE).select(F.col("doc_id").alias("page"), F.col("component_id").alias("_first")).distinct()
        streams = streams.join(alike, "page", "left").withColumn("page", F.when(F.col("open"), F.coalesce("_first", "page")).otherwise(F.col("page")))
    # a host that has no open blocks needs PAGES alone
    least = streams.where("open").groupBy("host").agg(F.ceil(F.countDistinct("page") * SHARE).alias("_least"))
    found = repeated(streams).join(least, "host", "left").where(f"pages >= coalesce(_least, {PAGES})")
    parts = found.select("host", "suffix", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    suffix = streams.select("host", "key", "stream").mapInArrow(_places, "host long, suffix long, key binary, place int")
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
    # a set: copies of a page have the same places, and so many copies need no more room than one;
    # both joins merge: Spark takes parts and places for as few as the suffixes and would send them all through the driver
    places = suffix.withColumn("part", part).join(parts.hint("merge"), ["host", "suffix", "part"]).groupBy("key").agg(F.collect_set("place").alias("places"))
    packed = source.select("page_id", "url", "key", "html").mapInArrow(_packed, f"page_id {id_type}, url string, key binary, packed binary")
    rest = packed.join(places.hint("merge"), "key", "left").select("page_id", "url", "packed", "places").mapInArrow(_uncovered, f"page_id {id_type}, url string, text string, n_repeated long")
    return rest.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
