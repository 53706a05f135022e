"""Toxicity: cumulative-link ordinal regression over sparse text features.

Features are hashed words and word beginnings. On a bounded sample of the distinct labelled texts,
weighted so that each label has its share of all of them (severity means the same at every size), the
features that go with toxic labels are selected by chi-square, loosely, and a ridge chooses among them; the sample's toxic documents are
graded 1 to 3 by how often those features occur, the others are grade 0. A proportional-odds
model, one weight vector for all ordered thresholds, gives P(grade > k), and their sum is the
expected severity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import _text
from tracewright.llm._store import kept

BITS = 20
#: Beginnings of words that are features besides whole words, in bytes.
PREFIXES = (4, 5, 6)
GRADES = 4
#: At most so many labelled texts are fitted on, half of them toxic if there are enough.
MOST_LABELLED = 8000
MIN_DOCUMENTS = 4
MIN_CHI2 = 15.0
RIDGE = 2e-4
REJECT = 0.3


@dataclass
class Model:
    features: np.ndarray  # sorted buckets
    weights: np.ndarray
    thresholds: np.ndarray  # ascending


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature occurrence and the text it is in."""
    data, offsets = _text.encoded(column)
    data = _text.lowered(data)
    starts, ends, first = _text.spans(data, offsets, _text.NON_WORD)
    owner = _text.owners(first)
    shift = np.uint64(64 - BITS)
    hashes, texts = [_text.hash_spans(data, starts, ends)], [owner]
    for k in PREFIXES:
        long = ends - starts > k
        hashes.append(_text.hash_spans(data, starts[long], starts[long] + k) + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        texts.append(owner[long])
    return (np.concatenate(hashes) * np.uint64(0x9FB21C651E98DF25) >> shift).astype(np.int64), np.concatenate(texts)


def _sparse(bucket: np.ndarray, text: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value log(1 + count) of the chosen features."""
    at = np.minimum(np.searchsorted(chosen, bucket), max(len(chosen) - 1, 0))
    hit = chosen[at] == bucket if len(chosen) else np.zeros(len(bucket), bool)
    pair, count = np.unique(text[hit] * max(len(chosen), 1) + at[hit], return_counts=True)
    return pair // max(len(chosen), 1), pair % max(len(chosen), 1), np.log1p(count)


def _counted(batches):
    """How many toxic and other texts of the sample hold each feature."""
    for piece in _text.slices(batches, most=1 << 20):
        bucket, text = features(piece.column("text"))
        seen = np.unique(text << BITS | bucket)
        bad = piece.column("_toxic").to_numpy(zero_copy_only=False)[seen >> BITS] > 0
        feature, at = np.unique(seen & ((1 << BITS) - 1), return_inverse=True)
        ill = np.bincount(at, weights=bad, minlength=len(feature)).astype(np.int64)
        yield pa.record_batch({"feature": pa.array(feature), "ill": pa.array(ill), "well": pa.array(np.bincount(at, minlength=len(feature)) - ill)})


def _chosen(feature: np.ndarray, ill: np.ndarray, well: np.ndarray, heavy: float, light: float, share: float) -> np.ndarray:
    """The features that go with toxic labels, by chi-square."""
    with_, all_ = ill * heavy, ill * heavy + well * light
    expected = all_ * share
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.nan_to_num((with_ - expected) ** 2 / (expected * max(1 - share, 1e-9)))
    return np.sort(feature[(ill >= MIN_DOCUMENTS) & (with_ > expected) & (chi2 >= MIN_CHI2)])


def train(row: np.ndarray, col: np.ndarray, value: np.ndarray, bad: np.ndarray, weight: np.ndarray, chosen: np.ndarray, steps: int = 500, rate: float = 0.5, ridge: float = RIDGE) -> Model:
    """Fit on sparse features (text, place in ``chosen``, value) of texts that are toxic or not; deterministic."""
    n = len(bad)
    if not bad.any():  # nothing is known of toxic texts: no text is one
        return Model(chosen[:0], np.zeros(0), np.full(GRADES - 1, np.inf))
    # grades from labels: 0, or 1..3 by the amount of evidence among the toxic ones
    evidence = np.bincount(row, weights=value, minlength=n)
    grade = np.zeros(n, np.int64)
    cuts = np.quantile(evidence[bad], [1 / 3, 2 / 3])
    grade[bad] = 1 + np.searchsorted(cuts, evidence[bad], side="right")
    w = np.zeros(len(chosen))
    theta = np.log(np.array([3.0 ** (k + 1) for k in range(GRADES - 1)]))  # ascending, kept so by steps below
    above = (grade[:, None] > np.arange(GRADES - 1)).astype(float)
    # P(y > k) = s(x.w - theta_k); gradient of the cumulative log-likelihood with shared w
    m = v = np.zeros(len(chosen) + GRADES - 1)
    for step in range(1, steps + 1):
        eta = np.bincount(row, weights=value * w[col], minlength=n)
        residual = weight[:, None] * (above - 1 / (1 + np.exp(-np.clip(eta[:, None] - theta, -30, 30))))
        g_w = np.bincount(col, weights=value * residual.sum(1)[row], minlength=len(chosen)) / n - ridge * w
        g = np.concatenate([g_w, -residual.mean(0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate / (1 + step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * 0.2
        w = np.maximum(w + move[: len(chosen)], 0)  # evidence only speaks for severity
        theta = np.maximum.accumulate(theta + move[len(chosen) :])
    return Model(chosen, w, theta)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` distinct labelled texts, chosen by their hash: copies under other ids change nothing.

    Null and empty texts and null labels or ids teach nothing; a text with both labels is toxic.
    Without a toxic text the model rejects none.
    Features are counted in the executors; the driver gets the counts of those that some toxic
    texts hold and, of each sampled text, its chosen features.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where("text <> ''").select("doc_id", F.xxhash64("text").alias("_hash"))
    distinct = kept(texts.join(known, "doc_id").groupBy("_hash").agg(F.max("toxic").alias("_toxic"), F.min("doc_id").alias("doc_id")), "labelled")
    total = {r["_toxic"]: r["count"] for r in distinct.groupBy("_toxic").count().collect()}
    ids = None
    for value in (1, 0):
        part = distinct.where(F.col("_toxic") == value).orderBy("_hash").limit(most // 2)
        ids = part if ids is None else ids.unionByName(part)
    chosen = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).join(ids, ["doc_id", "_hash"]).dropDuplicates(["_hash"])
    sample = kept(chosen.select("_hash", "text", "_toxic"), "sample")
    each = sample.select("_hash", "_toxic").toArrow().sort_by("_hash")
    bad = each["_toxic"].to_numpy() > 0
    own, share = bad.mean() if len(bad) else 0.0, total.get(1, 0) / max(total.get(0, 0) + total.get(1, 0), 1)
    share = share if 0 < own < 1 else own
    heavy, light = share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9)
    counts = sample.select("text", "_toxic").mapInArrow(_counted, "feature long, ill long, well long").groupBy("feature").agg(F.sum("ill").alias("ill"), F.sum("well").alias("well")).where(F.col("ill") >= MIN_DOCUMENTS).toArrow()
    use = _chosen(*(counts[c].to_numpy() for c in ("feature", "ill", "well")), heavy, light, share)

    def found(batches):
        for piece in _text.slices(batches, most=1 << 20):
            row, col, value = _sparse(*features(piece.column("text")), use)
            yield pa.record_batch({"_hash": piece.column("_hash").take(pa.array(row)), "col": pa.array(col), "value": pa.array(value, pa.float64())})

    cells = sample.select("_hash", "text").mapInArrow(found, "_hash long, col long, value double").toArrow().sort_by([("_hash", "ascending"), ("col", "ascending")])
    row = np.searchsorted(each["_hash"].to_numpy(), cells["_hash"].to_numpy())
    return train(row, cells["col"].to_numpy(), cells["value"].to_numpy(), bad, np.where(bad, heavy, light), use)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, severity, toxic`` and ``grade`` (the likeliest) of every row; null and empty texts have no features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for piece in _text.slices(batches, most=1 << 20):
            above = probabilities(piece.column("text"), shared.value)
            severity = above.sum(1)
            each = np.concatenate([np.ones((len(above), 1)), above], 1) - np.concatenate([above, np.zeros((len(above), 1))], 1)
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "severity": pa.array(severity), "grade": pa.array(each.argmax(1).astype(np.int32)), "toxic": pa.array(severity >= REJECT)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, severity double, grade int, toxic boolean")


def probabilities(column, model: Model) -> np.ndarray:
    """P(grade > k) of each text for every threshold."""
    bucket, text = features(column)
    row, col, value = _sparse(bucket, text, model.features)
    eta = np.bincount(row, weights=value * model.weights[col], minlength=len(column)) if len(model.features) else np.zeros(len(column))
    return 1 / (1 + np.exp(-np.clip(eta[:, None] - model.thresholds, -30, 30)))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Expected severity (0 to 3), likeliest grade and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose expected severity is below the limit, all columns; null and empty texts and repeated rows stay."""
    model = spark.sparkContext.broadcast(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    def run(batches):
        for piece in _text.slices(batches, most=1 << 20):
            calm = probabilities(piece.column("text"), model.value).sum(1) < REJECT
            yield piece.filter(pa.array(calm))

    return docs.mapInArrow(run, docs.schema)
