"""Benchmark decontamination by the q-gram lemma.

Texts and items are normalised: A-Z in lower case, runs of blanks one space, ends trimmed. If an
item of ``m`` bytes stands in a text with at most ``k`` edits, at least ``m - q + 1 - k * q`` of its
q-grams stand there unharmed, on diagonals at most ``2k`` apart. Shared q-grams are counted in
overlapping bands of diagonals; bands that reach the bound are verified by banded alignment.
Characters are UTF-8 bytes. ``k`` is ``EDIT_SHARE`` of ``m`` for items of every length; where the
lemma's bound would be below one q-gram, shorter q-grams are counted. Items of fewer than
``SHORTEST`` bytes are found where they stand as whole words without an edit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _text

Q = 10
#: Length of the q-grams of items for which Q is too long.
SHORT_Q = 6
#: Items of fewer bytes are found by whole words alone.
SHORTEST = 10
#: Edits allowed, as a share of the item's length.
EDIT_SHARE = 0.08
#: The items are searched in blocks of about so many bytes, each with one broadcast index ...
BLOCK_BYTES = 8 << 20
#: ... and so many blocks in one scan of the documents.
BLOCKS_A_SCAN = 8
_BITS = 22


def normalised(column) -> tuple[np.ndarray, np.ndarray]:
    """Normalised texts end to end, a newline after each, and len+1 offsets (newline included)."""
    data, offsets = _text.encoded(column)
    n = len(offsets) - 1
    starts, ends, first = _text.spans(data, offsets, _text.BLANK)
    # every word's bytes and one byte after it: a space, or the newline after a text's last word
    lengths = ends - starts + 1
    words = np.diff(first)
    sizes = np.maximum(_text.per_text(lengths, first), 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(bounds[-1], 32, np.uint8)
    to = np.cumsum(lengths) - lengths + np.repeat(np.cumsum(words == 0) - (words == 0), words)
    count = ends - starts
    ahead = np.cumsum(count) - count
    index = np.arange(count.sum())
    out[index + np.repeat(to - ahead, count)] = _text.lowered(data[index + np.repeat(starts - ahead, count)])
    out[bounds[1:] - 1] = 10
    return out, bounds


def _codes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A 32-bit hash of every q-gram, q = 10 (8 + 2) or 6 (4 + 2)."""
    if len(data) < q:
        return np.zeros(0, np.uint32)
    c1 = data.astype(np.uint32) + np.uint32(1)
    c2 = c1[:-1] * np.uint32(0x01000193) + c1[1:]
    main = c2[:-2] * np.uint32(0x85EBCA6B) + c2[2:]
    if q == Q:
        main = main[:-4] * np.uint32(0xC2B2AE35) + main[4:]
    return (main[: len(data) - q + 1] * np.uint32(0x27D4EB2F) + c2[q - 2 :]) * np.uint32(0x9E3779B1)


class _Grams:
    """Positions of the q-grams of items, and the bound each item's bands must reach."""

    def __init__(self, which: list[int], items: list[np.ndarray], budget: np.ndarray, q: int):
        self.q, self.which = q, np.array(which, np.int64)
        own = [items[i] for i in which]
        k = budget[self.which] if len(own) else np.zeros(0, np.int64)
        self.needed = np.array([len(d) for d in own], np.int64) - q + 1 - k * q
        self.step = 2 * k + 1
        code = [_codes(d, q) for d in own]
        all_ = np.concatenate([np.zeros(0, np.uint32), *code])
        item = np.repeat(np.arange(len(code)), [len(c) for c in code])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(c)) for c in code]])
        order = np.argsort(all_, kind="stable")
        self.keys, at = np.unique(all_[order], return_index=True)
        self.bounds = np.append(at, len(all_))
        self.item, self.place = item[order], place[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.keys >> np.uint32(32 - _BITS)] = True

    def bands(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Text, item, first diagonal and number of diagonals of the bands that reach their bound."""
        if not len(self.which):
            return []
        code = _codes(data, self.q)
        at = np.flatnonzero(self.maybe[code >> np.uint32(32 - _BITS)])
        key = np.minimum(np.searchsorted(self.keys, code[at]), len(self.keys) - 1)
        same = self.keys[key] == code[at]
        at, key = at[same], key[same]
        n = self.bounds[key + 1] - self.bounds[key]
        post = np.repeat(self.bounds[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(at, n)
        item = self.item[post]
        text = np.searchsorted(bounds, at, side="right") - 1
        # a q-gram over a newline belongs to no text and no item has a newline
        diagonal = at - bounds[text] - self.place[post]
        # a diagonal is in two overlapping bands; shifted so that bands are not negative
        band = (diagonal + (1 << 40)) // self.step[item]
        text, item, band = np.concatenate([text, text]), np.concatenate([item, item]), np.concatenate([band, band - 1])
        order = np.lexsort((band, item, text))
        text, item, band = text[order], item[order], band[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)])) if len(text) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(text)))
        enough = new[count >= self.needed[item[new]]]
        step = self.step[item[enough]]
        return list(zip(text[enough].tolist(), self.which[item[enough]].tolist(), (band[enough] * step - (1 << 40)).tolist(), (2 * step).tolist(), strict=True))


class Index:
    """What a block of items is found by: q-grams, and whole words for the shortest."""

    def __init__(self, ids: list, texts: list[str | None]):
        data, bounds = normalised(pa.array(texts, pa.string()))
        items = [(i, data[bounds[j] : bounds[j + 1] - 1]) for j, i in enumerate(ids) if bounds[j + 1] - 1 > bounds[j]]
        self.ids, self.items = [i for i, _ in items], [d for _, d in items]
        m = np.array([len(d) for d in self.items], np.int64)
        self.budget = np.where(m < SHORTEST, 0, (m * EDIT_SHARE).astype(np.int64))
        long = m >= Q * (self.budget + 1)  # then Q leaves one unharmed q-gram at least
        self.grams = [_Grams(np.flatnonzero((m >= SHORTEST) & own).tolist(), self.items, self.budget, q) for own, q in ((long, Q), (~long, SHORT_Q))]
        self.words: dict[int, list[int]] = {}
        for i in np.flatnonzero(m < SHORTEST).tolist():
            self.words.setdefault(len(self.items[i]), []).append(i)

    def search(self, column) -> list[tuple[int, int, int, int]]:
        """Text, item, fewest edits and first byte of the match, for each item within its budget."""
        if not self.items:
            return []
        data, bounds = normalised(column)
        best: dict[tuple[int, int], tuple[int, int]] = self._whole_words(data, bounds)
        for t, i, low, wide in (x for g in self.grams for x in g.bands(data, bounds)):
            k = int(self.budget[i])
            edits, start = alignment(self.items[i], data[bounds[t] : bounds[t + 1] - 1], low, wide, k)
            if edits <= k:
                best[t, i] = min(best.get((t, i), (k + 1, 0)), (edits, start))
        return [(t, i, *found) for (t, i), found in sorted(best.items())]

    def _whole_words(self, data: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """First places where items of under SHORTEST bytes stand between blanks."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        if not self.words:
            return out
        gap = (data == 32) | (data == 10)
        begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        for length, items in self.words.items():
            at = begins[begins + length < len(data)]
            at = at[gap[at + length]]
            code = _text.hash_spans(data, at, at + length)
            for i in items:
                own = self.items[i]
                for p in at[code == _text.hash_spans(own, np.array([0]), np.array([length]))[0]].tolist():
                    t = int(np.searchsorted(bounds, p, side="right")) - 1
                    out.setdefault((t, i), (0, p - int(bounds[t])))
        return out


def alignment(item: np.ndarray, text: np.ndarray, low: int, wide: int, k: int) -> tuple[int, int]:
    """Fewest edits of the item against any part of the text near a band, and where that part begins.

    The band has ``wide`` diagonals from ``low``; an alignment with a q-gram on one of them stays
    within ``2k`` of it. Rows are the item's bytes, columns these diagonals; beginning and end in
    the text are free. Stops as soon as all of a row is over the budget.
    """
    low, wide = low - 2 * k, wide + 4 * k
    begin, end = max(0, low), min(len(text), low + wide + len(item))
    where = text[begin:end].tobytes().find(item.tobytes())
    if where >= 0:
        return 0, begin + where
    near = np.full(wide + len(item), 256, np.int16)  # no byte where the text has not begun or has ended
    near[begin - low : max(begin, end) - low] = text[begin:end]
    columns = np.arange(wide)
    row, origin = np.zeros(wide, np.int64), columns.copy()
    for i, x in enumerate(item.tolist()):
        across, down = row + (near[i : i + wide] != x), np.append(row[1:] + 1, k + 1)
        take = across <= down
        cost, begins = np.where(take, across, down), np.where(take, origin, np.append(origin[1:], 0))
        # bytes of the text that the item lacks run along the row: cost[d] + (here - d), smallest so far
        level = np.minimum.accumulate((cost - columns) * (wide + 1) + columns)
        source = level - np.floor_divide(level, wide + 1) * (wide + 1)
        row, origin = cost[source] + columns - source, begins[source]
        if row.min() > k:
            return k + 1, 0
    last = int(row.argmin())
    return int(row[last]), max(0, low + int(origin[last]))


def _blocks(benchmark: DataFrame) -> list[Index]:
    """Indexes of the items, block by block of bounded size."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        part = benchmark.select("item_id", "text").where(block == b).toArrow().to_pydict()
        yield Index(part["item_id"], part["text"])


def _scans(spark, benchmark: DataFrame):
    """The items' indexes, broadcast, as many at a time as one scan of the documents searches."""
    some = []
    for index in _blocks(benchmark):
        some.append(spark.sparkContext.broadcast(index))
        if len(some) == BLOCKS_A_SCAN:
            yield some
            some = []
    if some:
        yield some


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, budget, first_byte`` for every document and item it holds within the budget.

    ``budget`` is 0.08 of the item's normalised bytes, rounded down; of items under 10 bytes it is 0
    and they must stand as whole words. Null and empty items are held by nothing. ``first_byte``
    counts in the normalised text. Null and empty texts hold nothing; a repeated row reports for
    itself, and so does a repeated item.
    """
    out = None
    ids = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n, df in (("doc_id", docs), ("item_id", benchmark)))
    kind = pa.int64() if benchmark.schema["item_id"].dataType.simpleString() == "bigint" else None
    for scan in _scans(docs.sparkSession, benchmark):

        def run(batches, scan=scan):
            for piece in _text.slices(batches):
                for own in (shared.value for shared in scan):
                    found = own.search(piece.column("text"))
                    t = pa.array([x[0] for x in found], pa.int64())
                    yield pa.record_batch({"doc_id": piece.column("doc_id").take(t), "item_id": pa.array([own.ids[x[1]] for x in found], kind), "edits": pa.array([x[2] for x in found], pa.int64()), "budget": pa.array([int(own.budget[x[1]]) for x in found], pa.int64()), "first_byte": pa.array([x[3] for x in found], pa.int64())})

        part = docs.select("doc_id", "text").mapInArrow(run, f"{ids}, edits long, budget long, first_byte long")
        out = part if out is None else out.unionByName(part)
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, all columns; null and empty texts hold none, repeated rows stay."""
    for scan in _scans(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet")):

        def run(batches, scan=scan):
            for piece in _text.slices(batches):
                clean = np.ones(piece.num_rows, bool)
                for shared in scan:
                    clean[[x[0] for x in shared.value.search(piece.column("text"))]] = False
                yield piece.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
