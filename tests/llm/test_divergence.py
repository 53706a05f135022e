"""Divergence of sources: a plain version over all terms, shards and flushes of every size, odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tracewright.llm import divergence as V

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans({c: c.lower() for c in V._UPPER})


def brute(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t for t in re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if t]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        everywhere = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (everywhere[t] + 2) // (sum(everywhere.values()) + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out, key=str)


def texts(seed, n=160):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gämma", "Δelta", "x1y", "end.", "a-b", "été", "z", "\x00nul\x00", "日本", "Éa"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(n):
        source = rng.choice(["s0", "s0", "s1", "s2", "", None, "ß"])
        shift = 0 if source != "s1" else 20
        rows.append((i, " ".join(words[min(len(words) - 1, int(rng.expovariate(0.08)) + shift)] for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None, ""]), source))
    return rows + [(900, None, "en", "silent"), (901, "", "only", "a"), (902, "  ", "only", "b"), (903, "rare words", "few", "a"), (0, rows[0][1], rows[0][2], rows[0][3]), (0, rows[0][1], rows[0][2], rows[0][3])]


@pytest.mark.parametrize(("seed", "parts", "held"), [(1, 1, 10**6), (2, 5, 40), (3, 3, 500)])
def test_against_a_plain_version(spark, monkeypatch, seed, parts, held):
    monkeypatch.setattr(V, "HELD", held)  # the tasks of this session are forked from it or read the module anew: either is right
    rows = texts(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "1 AS term", "2 AS n", "3 AS item", "4 AS total")
    assert sorted([tuple(r) for r in V.divergence(docs).collect()], key=str) == brute(rows)


def test_partial_counts_are_flushed(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(V, "HELD", 20)
    rows = texts(5)
    batches = [pa.RecordBatch.from_pylist([{"lang": r[2], "source": r[3], "text": r[1]} for r in rows[i : i + 9]], schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())])) for i in range(0, len(rows), 9)]
    out = [r for b in V._counted(iter(batches)) for r in b.to_pylist()]
    n, docs = Counter(), Counter()
    for r in out:
        n[r["lang"], r["term"]] += r["n"]
        docs[r["lang"], r["term"]] += r["docs"]
    want, want_docs = Counter(), Counter()
    for _, text, lang, _ in rows:
        terms = [t for t in re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if t]
        want.update((lang or "", t) for t in terms)
        want_docs.update((lang or "", t) for t in set(terms))
    assert n == want and docs == want_docs and len(out) > len({(r["lang"], r["source"], r["term"]) for r in out})


def test_other_limits_and_empty_table(spark):
    rows = texts(7)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted([tuple(r) for r in V.divergence(docs, least_docs=3, top=4).collect()], key=str) == brute(rows, 3, 4)
    assert V.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
