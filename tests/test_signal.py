"""Text attention on small texts: tokens, limits, formats, novelty with and without eviction, scores, packs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.operators import signal as S


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "d int, text string")


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2024-01-02T10:11:12.5Z start", "<timestamp> start"),
        ("on 2024-01-02 at 10:11", "on <date> at <time>"),
        ("id 123e4567-e89b-12d3-a456-426614174000", "id <uuid>"),
        ("from 10.0.0.1 by a.b@c.org", "from <ipv4> by <email>"),
        ("see https://x.org/a?b=1 now", "see <url> now"),
        ("say 'it \\' is' and \"so\"", "say <quoted> and <quoted>"),
        ("took 12 ms, then 3.5h, 7 MB", "took <duration>, then <duration>, <bytes>"),
        ("0xFF and deadbeefdeadbeef", "<hex> and <hex>"),
        ("/var/log/a.txt", "<unix-path>"),
        ("open (/var/log) in C:\\temp\\x", "open (<path>) in <windows-path>"),
        ("-1.5 and -22 but 1.2.3 and 7", "<decimal> and <integer> but 1.2.3 and 7"),
        ("\x1b[31mred\x1b[0m \t end ", "red end"),
        ("", ""),
    ],
)
def test_template(spark, line, want):
    assert frame(spark, line).select(S.template(F.col("text")).alias("v")).first()["v"] == want


def test_lines_blocks_indent_delimiter(spark):
    rows = S.lines(frame(spark, "\na,b\r\n\n \n\tx|y\r- q", None), "d").orderBy("d", "line_no").collect()
    assert [(r["line_no"], r["blank"], r["block"], r["indent"], r["delimiter"]) for r in rows] == [
        (1, True, 0, 0, "none"), (2, False, 0, 0, ","), (3, True, 1, 0, "none"), (4, True, 1, 1, "none"), (5, False, 1, 2, "|"), (6, False, 1, 0, "none"), (1, True, 0, 0, "none"),
    ]


def test_validation_and_routing(spark):
    texts = ["", None, "a\nb\nc\nd\ne", "x\x00\x01y", "A" * 6000, "a b\n" * 20001, "z" * (256 * 1024 + 1) + "\n" + "two words\n" * 60000]
    found = {r["d"]: (r["errors"], r["warnings"]) for r in S.validation(frame(spark, *texts), "d").collect()}
    assert found[0] == found[1] == (["empty"], ["small"])
    assert found[2] == ([], [])
    assert found[3] == (["binary"], ["small"])
    assert found[4] == (["encoded"], ["small"])
    assert found[5] == (["too_many_lines"], [])
    assert found[6] == (["too_many_lines"], ["long_lines"])
    data = ['[1,\n2]', "{not\njson}", "<a x='1'>\n</a>", "<a>\n</b>", "a,b,c\n1,2,3\n4,5,6", "a,b\n1,2\n3,4", "a\tb\tc\n" * 3, "a: 1\nb: 2\nc: 3\nd: 4", "a: 1\nb: 2\nc: 3", "[1]", None]
    formats = {r["d"]: r["format"] for r in S.routing(frame(spark, *data), "d").collect()}
    assert [formats[i] for i in range(len(data))] == ["JSON", None, "XML", None, "CSV", None, "TSV", "YAML", None, None, None]


def test_features_and_negations(spark):
    texts = ["no errors and 0 errors", "an error", "request passed without any new error", "errors: 0", "shall not exceed at most 5 rows", "TODO: owner decision", ""]
    got = {}
    for r in S.features(S.lines(frame(spark, *texts), "d"), "d").collect():
        got.setdefault(r["d"], []).append(r["feature"])
    assert got == {1: ["error"], 4: ["prohibition", "obligation", "threshold"], 5: ["decision", "action"]}
    found = S.evidence(S.lines(frame(spark, "see `a b` of 2024-01-02, 5 rows, /usr/lib/x, ABC-12"), "d"), "d").collect()
    assert {r["kind"]: r["value"] for r in found} == {"date": "2024-01-02", "quantity": "5 rows", "field": "`a b`", "path": " /usr/lib/x", "identifier": "ABC-12"}


def plain_novelty(text, entries):
    """The same by one walk over bytes, forgetting the grams used longest ago."""
    known, out = [], {}
    for number, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        b = line.encode()
        sampled = [b[i : i + 4] for i in range(0, max(0, len(b) - 3), 2 if len(b) > 48 else 1)]
        own = list(dict.fromkeys(sampled))
        unseen = sum(g not in known for g in own)
        reach = max(0, min(48, len(b) - 7))
        value = (20000 * unseen * reach + 48 * len(sampled)) // (96 * len(sampled)) if sampled else 0
        out[number] = (min(value, 4500) if len(b) < 20 else value) / 10000
        for g in own:
            if g in known:
                known.remove(g)
            known.append(g)
            known = known[-entries:]
    return out


@pytest.mark.parametrize("entries", [20, 200, 32768])
def test_novelty_equals_a_plain_walk(spark, entries):
    rng = random.Random(5)
    text = "\n".join("".join(rng.choice("abä ") for _ in range(rng.choice([0, 3, 9, 30, 80]))) for _ in range(60))
    x = S.lines(frame(spark, text), "d")
    assert {r["line_no"]: r["novelty"] for r in S.novelty_evicting(x, "d", entries).collect()} == plain_novelty(text, entries)
    if entries == 32768:
        assert {r["line_no"]: r["novelty"] for r in S.novelty(x, "d").collect()} == plain_novelty(text, entries)


def test_restatement_of_repeated_lines(spark):
    a, b = "service accounts rotate their keys weekly", "Note: service accounts rotate their keys weekly"
    text = "\n".join([b, a, a, b, "something else entirely said here today"])
    rows = S.restatements(S.lines(frame(spark, text), "d"), "d").collect()
    assert sorted((r["line_no"], r["earlier"], r["similarity"]) for r in rows) == [(2, 1, 0.857), (3, 1, 0.857), (4, 2, 0.857)]


def test_restatements_of_long_lines_move_no_words_by_prefix(spark):
    words = [f"w{i:04d}" for i in range(300)]
    text = "\n".join([" ".join(words), "Note: " + " ".join(words), " ".join(reversed(words[:250])), " ".join(f"u{i:04d}" for i in range(300))])
    found = S.restatements(S.lines(frame(spark, text), "d"), "d")
    assert sorted((r["line_no"], r["earlier"], r["similarity"]) for r in found.collect()) == [(2, 1, 0.997), (3, 1, 0.833)]
    # a row for each word of a prefix carries numbers only
    text_plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in text_plan and "_w#" not in text_plan


def test_restatements_find_every_pair(spark):
    import random

    r = random.Random(5)
    pool = [f"{'abcdefgh'[i % 8] * (3 + i % 5)}{i}" for i in range(14)]
    said = [" ".join(r.sample(pool, r.randint(3, 9))) + (" -" if i % 2 else "") for i in range(70)]
    rows = S.restatements(S.lines(frame(spark, "\n".join(said)), "d"), "d").collect()
    want, sets = {}, [set(x.replace(" -", "").split()) for x in said]
    for i, t in enumerate(sets):
        near = [(len(t & u) / len(t | u), -j) for j, u in enumerate(sets[:i]) if said[j] != said[i] and min(len(t), len(u)) >= 4]
        if near and max(near)[0] >= 0.64:
            want[i + 1] = (1 - max(near)[1], round(max(near)[0], 3))
    assert len(want) > 10 and {x["line_no"]: (x["earlier"], x["similarity"]) for x in rows} == want


def test_empty_table_and_pack(spark):
    none = S.lines(spark.createDataFrame([], "d int, text string, line string, tpl string"), "d")
    assert S.findings(none, "d").count() == S.modes(none, "d").count() == S.restatements(none, "d").count() == S.novelty_evicting(none, "d").count() == 0
    text = "\n".join(["INFO job 12 done in 30 ms"] * 9 + ["FATAL disk failure", "", "INFO job 14 done in 30 ms"])
    x = S.lines(frame(spark, text), "d")
    pack = S.evidence_pack(x, "d", pinned=spark.createDataFrame([(0, 2), (0, 11)], "d int, line_no int"), context=1).collect()
    assert {r["line_no"]: r["reasons"] for r in pack} == {1: ["context"], 2: ["pinned"], 3: ["context"], 9: ["context"], 10: ["attention"]}
    assert S.modes(x, "d").first()["mode"] == "stream"


def test_novelty_is_of_the_first_line_with_a_gram(spark):
    """A fold over each text gives what the first line of each four bytes gives, without a row for each of them."""
    rng = random.Random(7)
    line = lambda: "".join(rng.choice("aé 😀b") for _ in range(rng.choice((0, 1, 3, 4, 5, 19, 20, 47, 48, 49, 50, 90))))
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 20))) for _ in range(12)] + ["", "abc", "a" * 49 + "\nb\n" + "a" * 49]
    x = S.lines(frame(spark, *texts), "d")
    want = {}
    for d, text in enumerate(texts):
        known = set()
        for i, b in enumerate(t.encode() for t in text.split("\n")):
            if b.decode().strip():
                grams = [b[j : j + 4] for j in range(0, len(b) - 3, 2 if len(b) > 48 else 1)]
                new, reach = len(set(grams) - known), max(0, min(48, len(b) - 7))
                value = (2 * 10000 * new * reach + 48 * len(grams)) // (2 * 48 * len(grams)) if grams else 0
                want[d, i + 1] = (min(value, 4500) if len(b) < 20 else value) / 10000
                known |= set(grams)
    y = S.novelty(x, "d")
    assert {(r["d"], r["line_no"]): r["novelty"] for r in y.collect()} == want
    assert "Generate explode(grams" not in y._jdf.queryExecution().executedPlan().toString()


def test_novelty_folds_many_texts_in_one_call(spark, monkeypatch):
    """Pieces of any size give each text what it gets alone, lines in any order; no call for each text."""
    rng = random.Random(4)
    texts = [[(n + 1, "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 90))).encode()) for n in range(rng.randrange(1, 12))] for _ in range(30)]
    kind = pa.list_(pa.struct([("line_no", pa.int64()), ("_b", pa.binary())]))

    def fold(some, most):
        monkeypatch.setattr(S, "FOLDED", most)
        rows = [[{"line_no": n, "_b": b} for n, b in rng.sample(t, len(t))] for t in some]
        batch = pa.record_batch([pa.array(range(len(some))), pa.array(rows, kind)], ["_k", "_ls"])
        return [r for b in S._unseen([batch, batch.slice(0, 0), batch.slice(len(some) // 2)]) for r in b.column("_r").to_pylist()]

    alone = [fold([t], 1)[0] for t in texts]
    for most in (1, 500, 1 << 20):
        assert fold(texts, most) == alone + alone[len(texts) // 2 :]
    for t, rows in zip(texts, alone):
        known = set()
        for (n, b), r in zip(t, rows, strict=True):
            own = {b[i : i + 4] for i in range(0, len(b) - 3, 2 if len(b) > 48 else 1)}
            assert (r["line_no"], r["bytes"], r["_new"]) == (n, len(b), len(own - known))
            known |= own
    plan = S.novelty(S.lines(spark.createDataFrame([(1, "a line")], "k long, text string"), "k"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
