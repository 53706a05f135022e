"""Quality classifier: supervised subword embeddings.

Words, byte n-grams (with word edges) and a marker for a word that repeats the one before it are
hashed into learned vectors; a document is the average of its vectors, a softmax over the two labels follows. Vectors and output weights are
trained together by mini-batch stochastic gradient descent in numpy on a bounded sample of the
labelled documents; scoring covers every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _text

BITS = 17
DIMENSIONS = 16
NGRAMS = (3, 4)
#: At most so many labelled documents are trained on.
MOST_LABELLED = 4000
EPOCHS = 6
CUT = 0.7
#: The bucket of the marker.
REPEATED = 0


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dimensions
    output: np.ndarray  # dimensions x 2
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """What each bucket adds to logit(label 1) - logit(label 0), before averaging."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0])


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and n-gram occurrence, and len+1 bounds per text."""
    data, offsets = _text.encoded(column)
    starts, ends, first = _text.spans(data, offsets, _text.BLANK)
    hashes = _text.hash_spans(data, starts, ends)
    words = (hashes >> np.uint64(64 - BITS)).astype(np.int32)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (_text.owners(first)[1:] == _text.owners(first)[:-1])) + 1
    # each text between blanks, all blanks alike: n-grams see where words begin and end
    n = len(offsets) - 1
    marked = np.full(len(data) + n + 1, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    marked[place] = np.where(_text.BLANK[data], 32, data)
    blank = marked == 32
    buckets, bounds = [words, np.full(len(again), REPEATED, np.int32)], [first, np.searchsorted(again, first)]
    texts = offsets + np.arange(n + 1)
    for k in NGRAMS:
        size = len(marked) - k + 1
        if size <= 0:
            continue
        code = np.full(size, k, np.uint32)
        ok = np.ones(size, bool)
        for j in range(k):
            code = code * np.uint32(0x01000193) + marked[j : j + size]
            if 0 < j < k - 1:
                ok &= ~blank[j : j + size]
        place = np.flatnonzero(ok)
        buckets.append(((code[place] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32))
        bounds.append(np.searchsorted(place, texts))
    return _joined(buckets, bounds)


def _joined(parts: list[np.ndarray], bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = len(bounds[0]) - 1
    total = sum(bounds)
    out = np.empty(total[-1], np.int32)
    ahead = total[:-1].copy()
    for part, b in zip(parts, bounds, strict=True):
        counts = np.diff(b)
        out[np.arange(b[-1]) + np.repeat(ahead - b[:-1], counts)] = part[: b[-1]]
        ahead += counts
    assert n == len(total) - 1
    return out, total


def train(column, label: np.ndarray, epochs: int = EPOCHS, rate: float = 1.0, seed: int = 0) -> Model:
    """Mini-batch SGD over texts; deterministic."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32))
    rows = []
    for at in range(0, len(label), 64):
        bucket, bound = features(column.slice(at, 64))
        for i in range(len(bound) - 1):
            b, c = np.unique(bucket[bound[i] : bound[i + 1]], return_counts=True)
            rows.append((b, (c / max(c.sum(), 1)).astype(np.float32)))
    steps, step = max(1, epochs * -(-len(rows) // 16)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 16):
            batch = order[at : at + 16]
            b = np.concatenate([rows[i][0] for i in batch])
            w = np.concatenate([rows[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            member = np.zeros((len(batch), len(b)), np.float32)
            member[owner, np.arange(len(b))] = w
            hidden = member @ model.vectors[b]
            logits = hidden @ model.output + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), label[batch]] -= 1
            lr = rate * (1 - step / steps)
            back = p @ model.output.T
            model.output -= lr / len(batch) * hidden.T @ p
            model.bias -= lr / len(batch) * p.sum(0)
            # a text's vectors move by its own gradient, shared by how much of the text each is
            np.subtract.at(model.vectors, b, (lr * 20 * w)[:, None] * back[owner])
            step += 1
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Train on at most ``most`` labelled documents outside the held-out part, chosen by a hash."""
    known = labels.where("quality is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    ids = known.groupBy("doc_id").agg(F.max("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "_quality").toArrow().sort_by("doc_id")
    return train(sample["text"].combine_chunks(), sample["_quality"].to_numpy(zero_copy_only=False).astype(np.int64))


def probability(column, margins: np.ndarray, bias: float) -> np.ndarray:
    """P(label 1) of each text; texts without features get the bias alone."""
    bucket, bound = features(column)
    z = _text.per_text(margins[bucket], bound) / np.maximum(np.diff(bound), 1) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null id is not held out, a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margins().astype(np.float64), float(model.bias[1] - model.bias[0])))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for piece in _text.slices(batches, most=2 << 20):
            score = probability(piece.column("text"), *shared.value)
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= cut).astype(np.int32))})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
