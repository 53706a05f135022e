"""The stream's memory: against plain walks, evictions, restarts in the middle, texts over several micro-batches."""

import random
from collections import OrderedDict, deque

import pytest
from pyspark.sql import functions as F

from tracewright.operators import signal as S
from tracewright.streaming import memory as M


def some_lines(seed, n=60, key=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(14)]
    return [(key, i + 1, " ".join(rng.sample(words, rng.randrange(3, 9))) + (f" {rng.randrange(100, 999)}" if rng.random() < 0.3 else "") if rng.random() > 0.1 else "  ") for i in range(n)]


def plain_restatements(rows, words, most):
    """rows: line_no, tokens, template. Every word's last lines are looked up afresh, words in order of use."""
    of, lines, out = OrderedDict(), {}, {}
    for n, tokens, template in rows:
        own = set(tokens)
        if len(own) < M.TOKENS:
            continue
        near = [(len(own & lines[m][0]) / len(own | lines[m][0]), -m) for m in {m for w in own for m in of.get(w, ())} if lines[m][1] != template]
        near = max((x for x in near if x[0] >= M.LEAST), default=None)
        if near:
            out[n] = (-near[1], round(near[0], 3))
        lines[n] = (own, template)
        for w in sorted(own):
            of.setdefault(w, deque(maxlen=most)).append(n)
            of.move_to_end(w)
            if len(of) > words:
                of.popitem(last=False)
    return out


@pytest.mark.parametrize(("words", "most"), [(10**6, 16), (9, 3), (5, 1)])
def test_postings_equal_a_plain_walk_across_saves(words, most):
    rng = random.Random(words)
    rows = [(n, [f"t{rng.randrange(12)}" for _ in range(rng.randrange(2, 9))], rng.randrange(3)) for n in range(300)]
    got, memory = {}, M.Postings(b"", words, most)
    for n, tokens, template in rows:
        earlier, near = memory.restated(n, tokens, template)
        if earlier is not None:
            got[n] = (earlier, near)
        if n % 7 == 0:
            memory = M.Postings(memory.data(), words, most)
    assert got == plain_restatements(rows, words, most)
    assert len(memory.of) <= words and len(memory.lines) <= words * most


def test_grams_are_forgotten_in_order_of_use():
    g = M.Grams(b"", 3)
    assert g.unseen([1, 2, 3]) == 3 and g.unseen([1]) == 0 and g.unseen([4]) == 1
    g = M.Grams(g.data(), 3)  # 2 was used longest ago
    assert g.unseen([3, 1, 4]) == 0 and g.unseen([2]) == 1 and len(g.known) == 3


def stream(spark, tmp_path, name, path):
    M.written(M.remembered(M.line_stream(spark, path, "k", files=1), "k", grams=60), f"{tmp_path}/{name}", f"file://{tmp_path}/{name}-state")
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect())


def test_a_stream_equals_the_fold_and_survives_a_restart(spark, tmp_path):
    texts = {k: "\n".join(line for _, _, line in some_lines(k)) for k in range(4)}
    df = spark.createDataFrame(list(texts.items()), "k long, text string")
    for i in range(4):  # a file for each text
        df.where(F.col("k") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    whole = stream(spark, tmp_path, "whole", f"{tmp_path}/all")
    fold = S.novelty_evicting(S.lines(df, "k"), "k", entries=60)
    assert [(k, n, v) for k, n, v, _, _ in whole] == sorted((r["k"], r["line_no"], r["novelty"]) for r in fold.collect())
    prepared = {}
    for r in M.prepared(S.lines(df, "k"), "k").orderBy("key", "line_no").collect():
        prepared.setdefault(r["key"], []).append((r["line_no"], r["tokens"], r["template"]))
    want = {(k, n): v for k, rows in prepared.items() for n, v in plain_restatements(rows, M.WORDS, M.POSTINGS).items()}
    assert {(k, n): (e, s) for k, n, _, e, s in whole if e is not None} == want and want
    # the same texts, the stream stopped after two files and started again
    for i in range(2):
        df.where(F.col("k") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts")
    first = stream(spark, tmp_path, "parts-out", f"{tmp_path}/parts")
    for i in range(2, 4):
        df.where(F.col("k") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts")
    assert len(first) < len(whole) and stream(spark, tmp_path, "parts-out", f"{tmp_path}/parts") == whole


def test_a_text_goes_on_in_later_batches(spark, tmp_path):
    rows = some_lines(9, 40, key=5)
    session = spark.newSession()
    for k, v in M._ROCKS.items():
        session.conf.set(k, v)
    for at in (0, 20):
        spark.createDataFrame(rows[at : at + 20], "k long, line_no long, line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        lines = session.readStream.schema("k long, line_no long, line string").parquet(f"{tmp_path}/in")
        M.written(M.remembered(lines, "k", grams=50), f"{tmp_path}/out", f"file://{tmp_path}/state")
    whole = S.novelty_evicting(S.marked(spark.createDataFrame(rows, "k long, line_no long, line string"), "k"), "k", entries=50)
    assert sorted((r["line_no"], r["novelty"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted((r["line_no"], r["novelty"]) for r in whole.collect())


def test_saved_memories_are_no_larger_than_their_text():
    lines = [(n, line) for _, n, line in some_lines(3, 400) if line.strip()]
    grams, postings = M.Grams(), M.Postings()
    for n, line in lines:
        assert M._words(line.encode()) == list(dict.fromkeys(w for w in line.split() if len(w) > 2))
        postings.restated(n, M._words(line.encode()), n)
        grams.unseen(M.sampled(line.encode()))
    again = M.Postings(postings.data())
    assert again.of == postings.of and again.lines == postings.lines and list(M.Grams(grams.data()).known) == list(grams.known)
    assert len(grams.data()) + len(postings.data()) < sum(len(line) for _, line in lines)


def test_words_of_other_lines_are_sparks(spark, tmp_path):
    rows = [(1, "Größe der Datei KELVINK zwei drei"), (2, "drei zwei kelvink der datei größe 17"), (3, "plain words of an ascii LINE")]
    df = spark.createDataFrame([(1, "\n".join(t for _, t in rows))], "k long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = {r[1]: r[3] for r in stream(spark, tmp_path, "out", f"{tmp_path}/in")}
    plain = [(r["line_no"], r["tokens"], r["template"]) for r in M.prepared(S.lines(df, "k"), "k").orderBy("line_no").collect()]
    assert {n: e for n, e in got.items() if e is not None} == {n: e for n, (e, _) in plain_restatements(plain, M.WORDS, M.POSTINGS).items()}
