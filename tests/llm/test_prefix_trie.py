"""The trie of shared beginnings: all nodes by brute force, ranges of every size, runs, loser tree, odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tracewright.llm import prefix_trie as T

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            turns[c].append((n is not None, n or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, ms in members.items():
        sub = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in sub if x)
        ends = ",".join(map(str, sorted(c for c in ms if whole[c] == k)))
        out.append((min(ms), len(k), min(members[k[:-1]]) if k else None, len(ms), kids[k], sum(not kids[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some(seed, convs=70, words=3):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randrange(0, 6)):
            rows.append((c, None if rng.random() < 0.05 and t == 0 else t, rng.choice(["u", "a", None]), " ".join(rng.choice("xy") for _ in range(rng.randrange(words))) or rng.choice([None, ""])))
    return rows


@pytest.mark.parametrize("size", [3, 17, 100, 10**6])
def test_all_nodes(spark, size):
    rows = some(size) + [(200, i, "u", "deep " * (i % 3)) for i in range(60)] + [(i, 0, "u", "same") for i in range(300, 420)] + [(None, 1, "u", "nobody")]
    rows += [(i, t, "a", f"tail {t}") for i in range(300, 420) for t in (1, 2, 3, 4, 5)] + [(-3, 0, "u", "x"), (7, 2, "u", "again"), (7, 2, "u", "again")]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS turns", "3 AS key", "4 AS w")
    # equal turn numbers are ordered by digest; these are equal in full or have one text each
    rows = [r for r in rows if r[0] != 7] + sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1] is not None, r[1] or 0, bytes(digest(spark, r[2], r[3]))))
    got = T.prefix_trie(turns, range_turns=size).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def digest(spark, role, text):
    one = spark.createDataFrame([(role, text)], "role string, text string")
    return one.select(T.turn_digest(one["role"], one["text"])).first()[0]


def test_empty_table_has_no_node(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).count() == 0


def test_conversation_without_turns_left(spark):
    # crc32("2") % 4 turns of the absent 0 stand in for as many of its own
    h = zlib.crc32(b"2") % 4
    rows = [(2, t, "u", "x") for t in range(h)] or [(2, 0, "u", "x")]
    assert sorted(map(tuple, T.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def records(seed, n, alphabet=3, longest=12):
    rng = random.Random(seed)
    return [([bytes([rng.randrange(alphabet)]) * T._WIDTH for _ in range(rng.randrange(longest))], rng.randrange(10**6), []) for _ in range(n)]


@pytest.mark.parametrize("run_turns", [1, 40, 500, 10**6])
def test_merged_runs_carry_lcps(tmp_path, run_turns):
    rows = [(t, i, [1] * len(t)) for t, i, _ in records(run_turns, 600)]
    runs = T.sorted_runs(iter(rows), str(tmp_path), run_turns)
    tree = T.LoserTree(runs)
    got = list(tree)
    want = sorted(rows, key=lambda r: (r[0], r[1]))
    assert [(t, i) for t, i, _, _ in got] == [(t, i) for t, i, _ in want]
    before = []
    for t, _, _, lcp in got:
        assert lcp == T.common(before, t, 0)
        before = t


def test_shared_turns_are_not_compared_again(tmp_path):
    shared = [bytes([9]) * T._WIDTH] * 1000
    rows = [([*shared, bytes([i % 250]) * T._WIDTH], i, [1] * 1001) for i in range(400)]
    tree = T.LoserTree(T.sorted_runs(iter(rows), str(tmp_path), 25_000))
    assert len(tree.runs) > 10 and len(list(tree)) == 400
    assert tree.compared < 1000 * len(tree.runs) * 2 + 400 * 10  # not 400 x 1000 x log of the runs
