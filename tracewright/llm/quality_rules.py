"""Quality rules: hashed n-gram likelihood ratio between a trusted target and the raw corpus.

One pass counts hashed byte n-grams of all documents (raw) and of the documents that meet the
strict rules (trusted target) into two multinomials of a fixed number of buckets. A second pass
scores every document by its mean log-ratio per n-gram and compares it with a fixed threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _text

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = _text._table(map(ord, SYMBOLS))
NGRAM = 4
BUCKETS = 1 << 16
THRESHOLD = -0.25
SMOOTHING = 0.5
MIN_WORDS = 50

_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks the values that an earlier or later element of the same text equals; [1] only later ones."""
    own = _text.mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    any_, later = np.zeros(len(own), bool), np.zeros(len(own), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return np.stack([any_, later])


def base_counts(column) -> dict[str, np.ndarray]:
    """The plain counts of each text, see ``op3_quality_rules``."""
    data, offsets = _text.encoded(column)
    n = len(offsets) - 1
    starts, ends, first = _text.spans(data, offsets, _text.BLANK)
    visible = ~_text.BLANK[data] & ((data & 0xC0) != 0x80)
    out = {"n_words": np.diff(first), "word_chars": _text.per_text(visible, offsets), "n_symbols": _text.per_text(_SYMBOL[data], offsets)}
    ls, le, lfirst = _text.spans(data, offsets, _text.NEWLINE)
    has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    owner = _text.owners(lfirst)
    ls, le, owner = ls[has], le[has], owner[has]
    later = _repeats(_text.hash_spans(data, ls, le), owner)[1]
    out["n_dup_lines"] = np.bincount(owner[later], minlength=n)
    words = _text.hash_spans(data, starts, ends)
    counts = np.diff(first)
    windows, at = _text.shingle_hashes(words, first, 3)
    owner = _text.owners(at)
    full = (counts >= 3)[owner] if len(owner) else np.zeros(0, bool)
    found = np.flatnonzero(_repeats(windows, owner)[0] & full)
    place = found - at[owner[found]] + first[owner[found]]
    cover = np.zeros(len(words) + 3, bool)
    for j in range(3):
        cover[place + j] = True
    out["n_repeat_words"] = _text.per_text(cover[: len(words)], first)
    return {k: v.astype(np.int64) for k, v in out.items()}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def trusted(c: dict[str, np.ndarray]) -> np.ndarray:
    """Strict rules: long enough, under 2 % symbols, under 20 % repeated words, no repeated line."""
    return ~base_failed(c) & (100 * c["n_symbols"] < 2 * c["word_chars"]) & (5 * c["n_repeat_words"] < c["n_words"]) & (c["n_dup_lines"] == 0)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram, and len+1 bounds; n-grams do not cross texts."""
    n = np.maximum(np.diff(offsets) - NGRAM + 1, 0)
    if not len(data) or len(data) < NGRAM:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    size = len(data) - NGRAM + 1
    code = np.zeros(size, np.uint32)
    for j in range(NGRAM):
        code = code * np.uint32(0x01000193) + data[j : j + size] + np.uint32(1)
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    keep = np.ones(size, bool)
    for back in range(1, NGRAM):
        cut = offsets[1:-1] - back
        keep[cut[(cut >= 0) & (cut < size)]] = False
    bounds = np.concatenate([[0], np.cumsum(n)])
    code = code[keep]
    if len(code) != bounds[-1]:  # texts shorter than the n-gram: count what is kept by position
        place = np.flatnonzero(keep)
        bounds = np.searchsorted(place, offsets)
    return code, bounds


def _count_batches(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for piece in _text.slices(batches):
        column = piece.column("text")
        data, offsets = _text.encoded(column)
        code, bounds = ngrams(data, offsets)
        raw += np.bincount(code, minlength=BUCKETS)
        good = trusted(base_counts(column))
        target += np.bincount(code[np.repeat(good, np.diff(bounds))], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.record_batch({"bucket": pa.array(used, pa.int32()), "raw": pa.array(raw[used]), "target": pa.array(target[used])})


def fit(docs: DataFrame) -> np.ndarray:
    """The log-ratio of each bucket, from all documents; a fixed 0.5 MB whatever their number."""
    counts = docs.select("text").mapInArrow(_count_batches, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["bucket"].to_numpy()
    raw[at], target[at] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    return np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))


def scored(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the plain counts, ``base_failed``, ``llr`` (mean log-ratio) and ``kept`` of every row.

    Null and empty texts have no words and an ``llr`` of 0; they fail the base rule.
    """
    model = docs.sparkSession.sparkContext.broadcast(ratio)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for piece in _text.slices(batches):
            column = piece.column("text")
            c = base_counts(column)
            code, bounds = ngrams(*_text.encoded(column))
            llr = _text.per_text(model.value[code], bounds) / np.maximum(np.diff(bounds), 1)
            failed = base_failed(c)
            yield pa.record_batch({"doc_id": piece.column("doc_id"), **{k: pa.array(c[k]) for k in _COLUMNS}, "base_failed": pa.array(failed), "kept": pa.array(~failed & (llr >= threshold)), "llr": pa.array(llr)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {', '.join(f'{k} long' for k in _COLUMNS)}, base_failed boolean, kept boolean, llr double")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs))
