"""All five stages together, against a plain version of what they must keep."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tracewright.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    passage = " ".join(f"item{i} of{i} test{i}" for i in range(12))
    texts = {}
    for i in range(300):
        w = [word() for _ in range(rng.randrange(20, 60))]
        if i % 6 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vilex", "grubox", "snarlik"])
        texts[i] = " ".join(w)
    for i in range(300, 320):  # exact copies, near copies and copies of copies
        texts[i] = texts[301 - i % 7 - 6] if i % 2 else texts[i - 299] + " tail"
    for i in range(320, 325):
        texts[i] = " ".join(word() for _ in range(15)) + " " + passage + " " + word()
    texts |= {330: "", 331: None, 332: "lone"}
    rows = [(i, t, "en", ["a", "b", "b", "c", None][i % 5], len(t or "")) for i, t in texts.items()]
    rows.append(rows[1])  # a repeated row
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, passage


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def survivors(ids, texts):
    """The smallest id of each component of all pairs; texts without words stay."""
    first = {i: i for i in ids}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    sets = {i: shingles(texts[i]) for i in ids}
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                first[b] = a
    return {i for i in ids if root(i) == i}


def test_stages_together(spark, tmp_path):
    texts, passage = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, held = [], docs
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert held.columns == docs.columns, name
            held.write.parquet(f"{tmp_path}/{name}")
            held = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(held.collect())
    calm, single, clean, mix, tokens = kept
    # the weights are learned: documents with the planted words go, and no other
    toxic = {i for i, t in texts.items() if t and {"vilex", "grubox", "snarlik"} & set(t.split())}
    assert {r["doc_id"] for r in calm} == set(texts) - toxic and len(calm) == len(texts) - len(toxic) + 1
    want = survivors({r["doc_id"] for r in calm}, texts)
    assert sorted(r["doc_id"] for r in single) == sorted(want) and {301, 313} - want
    want = {i for i in want if passage not in (texts[i] or "")}
    assert sorted(r["doc_id"] for r in clean) == sorted(want) and not want & set(range(320, 325))
    # each source by its weight; here no source reaches three times its size
    size = {}
    for r in clean:
        size[r["source"]] = size.get(r["source"], 0) + len((r["text"] or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    taken = dict.fromkeys(names, 0)
    for r in mix:
        words, own = r["text"].split(), texts[r["doc_id"]].split()
        assert r["doc_id"] in want and words == own[: len(words)] and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(words)
    for s in names:
        target = sum(size.values()) * weight[s] / sum(weight.values())
        assert target < 3 * size[s] and abs(taken[s] - target) <= 1, s
    # the files hold the mix in order of ids
    coder, at = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), 0
    plain = {}
    for r in mix:
        ids = np.array([*coder.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        plain.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in sorted(tokens, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        plain[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    order = [r["doc_id"] for r in sorted(tokens, key=lambda r: r["start"])]
    assert order == sorted(order) and not any(plain.values())


def test_stages_of_empty_tables(spark, tmp_path):
    fixture(spark, tmp_path)
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == [], name
    quiet = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.probabilities(pa.array(["any text", None, ""]), quiet).sum(1).max() < toxicity.REJECT
    quiet = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet").where("toxic = 0"))
    assert toxicity.probabilities(pa.array(["vilex grubox"]), quiet).sum(1).max() < toxicity.REJECT
