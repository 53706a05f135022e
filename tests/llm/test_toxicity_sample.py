"""The sample that toxicity is fitted on, against all labelled texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewright.llm import toxicity

SCHEMA = "doc_id long, text string"


def table(spark, n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        w, bad = [f"w{rng.randrange(300)}" for _ in range(30)], i % 6 == 0
        for _ in range(rng.randrange(1, 5) if bad else 0):
            w[rng.randrange(30)] = rng.choice(["vilex", "grubox", "snarlik"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_verdicts_stay_when_labels_are_repeated(spark):
    docs, labels = table(spark)
    times = spark.range(10).select((F.col("id") * 1000).alias("_add"))
    again = lambda df: df.crossJoin(times).withColumn("doc_id", F.col("doc_id") + F.col("_add")).drop("_add")
    one, ten = toxicity.fit(docs, labels, most=300), toxicity.fit(again(docs), again(labels), most=300)
    texts = pa.array([r["text"] for r in docs.collect()])
    a, b = (toxicity.probabilities(texts, m).sum(1) for m in (one, ten))
    assert np.array_equal(a, b)


def test_severity_does_not_hang_on_the_share_in_the_sample(spark):
    docs, labels = table(spark)
    whole, sample = toxicity.fit(docs, labels), toxicity.fit(docs, labels, most=200)  # 100 of 100 toxic, 100 of 500 others
    plain = [toxicity.probabilities(pa.array(["nothing of note"]), m).sum() for m in (whole, sample)]
    assert abs(plain[0] - plain[1]) < 0.3 * plain[0]


def test_text_with_both_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c"), (5, "d"), (None, "e")], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1), (5, 0), (6, None)], "doc_id long, toxic int")
    assert len(toxicity.scored(docs, toxicity.fit(docs, labels)).collect()) == 7
    assert len(toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).collect()) == 7


def test_held_out_toxic_texts_are_found(spark):
    """A quarter of the distinct texts is held out: nine of ten toxic ones are rejected, and hardly a clean one."""
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    held = docs.where(F.crc32(F.col("text").cast("binary")) % 4 == 0)
    model = toxicity.fit(docs.join(held.select("doc_id"), "doc_id", "left_anti"), labels)
    got = toxicity.scored(held, model).select("doc_id", F.col("toxic").alias("rejected")).join(labels.where("toxic is not null"), "doc_id")
    n = {(r["toxic"], r["rejected"]): r["count"] for r in got.groupBy("toxic", "rejected").count().collect()}
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * (n[0, False] + n.get((0, True), 0))
