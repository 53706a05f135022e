"""Language model on sequences longer than a segment, and short benchmark items."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_rest import edits

from tracewright.llm import decontamination as D
from tracewright.llm import language_model as LM


def plain_counts(seqs, m):
    """Forward-backward of one sequence after another, without cuts."""
    k = len(m.start)
    starts, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros((len(m.emit), k))
    for x in seqs:
        a = [m.start * m.emit[x[0]]]
        a[0] /= a[0].sum()
        for s in x[1:]:
            v = (a[-1] @ m.move) * m.emit[s]
            a.append(v / v.sum())
        b = np.ones(k)
        for t in range(len(x) - 1, -1, -1):
            g = a[t] * b / (a[t] * b).sum()
            np.add.at(emissions, x[t], g)
            if t:
                xi = a[t - 1][:, None] * m.move * (m.emit[x[t]] * b)[None, :]
                moves += xi / xi.sum()
                b = m.move @ (m.emit[x[t]] * b)
                b /= b.sum()
            else:
                starts += g
    return starts, moves, emissions


@pytest.mark.parametrize(("segment", "block", "lengths"), [(4, 3, range(1, 24)), (256, 4096, (1, 255, 256, 257, 512, 1300, 40))])
def test_counts_of_whole_sequences(monkeypatch, segment, block, lengths):
    monkeypatch.setattr(LM, "SEGMENT", segment)
    monkeypatch.setattr(LM, "BLOCK", block)
    rng = np.random.default_rng(2)
    k, s = 4, 30
    m = LM.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.full(k, 0.3), k), rng.dirichlet(np.full(s, 0.3), k).T + 1e-9)
    seqs = [rng.integers(0, s, n) for n in lengths]
    flat, bounds = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(x) for x in seqs])])
    for got, want in zip(LM.expected_counts(flat, bounds, m), plain_counts(seqs, m), strict=True):
        assert np.allclose(got, want)


def test_rounds_raise_the_likelihood(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        state, out = rng.randrange(2), []
        for _ in range(rng.choice([5, 40, 700])):
            state = state if rng.random() < 0.9 else 1 - state
            out.append(f"{'ab'[state]}{rng.randrange(40)}")
        rows.append((i, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = []
    for rounds in (0, 1, 3, 8):
        got = LM.language_model(docs, states=2, rounds=rounds).where("not held_out").selectExpr("sum(score) s").first()
        score.append(got["s"])
    assert score == sorted(score) and score[-1] > score[0] + 1


def test_items_of_every_length_match_full_alignment():
    rng = random.Random(8)
    letters = "abcdefghij klm "
    text = lambda n: " ".join("".join(rng.choice(letters) for _ in range(n)).split()) or "abc"
    items = [text(n + 4)[:n].strip() for n in [*range(10, 42), 120, 400]]
    texts = []
    for i in range(150):
        p = list(items[i % len(items)])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(p))
            p[at : at + 1] = rng.choice([[], ["z"], [p[at], "y"]])
        texts.append(text(rng.choice([1, 60])) + "".join(p) + text(20))
    index = D.Index(list(range(len(items))), items)
    found = {(t, i): (e, at) for t, i, e, at in index.search(pa.array(texts))}
    norm, bounds = D.normalised(pa.array(texts))
    hits = 0
    for t in range(len(texts)):
        whole = norm[bounds[t] : bounds[t + 1] - 1].tobytes()
        for j, own in enumerate(index.items):
            e, budget = edits(own.tobytes(), whole), int(index.budget[j])
            assert found.get((t, j), (None,))[0] == (e if e <= budget else None), (len(own), e, budget)
            if e <= budget:
                hits += 1
                at = found[t, j][1]
                assert min(edits(own.tobytes(), whole[at : at + n]) for n in range(max(0, len(own) - e), len(own) + e + 1)) == e
    assert hits > 60 and all(index.budget[j] == int(0.08 * len(own)) for j, own in enumerate(index.items))


def test_shortest_items_are_whole_words():
    index = D.Index([1, 2, 3], ["Yes", "a b", ""])
    assert sorted(index.search(pa.array(["yes", "eyes yesterday", "oh YES\n no", "a\tb", "ya b", None, ""]))) == [(0, 0, 0, 0), (2, 0, 0, 3), (3, 1, 0, 0)]
