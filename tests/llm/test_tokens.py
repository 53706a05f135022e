import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import tokens
from tracewright.llm._store import shared_folder

PATH = tokens.tokenizer_file()
TEXTS = ["The cat's  hat\ton", None, "", "<|endoftext|> don't", "é é \x1c a\x1cb\x85c\xa0d", "12 345 $$$ ok!!", "a " * 3000, "The cat's  hat\ton"]


def plain(text):
    return tokens._tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=5))
def test_ids_equal_whole_text_encoding(texts):
    ids, n = tokens.WordIds(PATH).encode(pa.array(texts, pa.string()), 1)
    assert ids.tolist() == [i for t in texts for i in plain(t)]
    assert n.tolist() == [len(plain(t)) for t in texts]


def test_cuts_case_and_marks_change_nothing():
    marks = "".join(map(chr, range(0x300, 0x370)))
    texts = [f"{a}{m}b" for a in "AIKSZ=<" for m in marks] + ["a.'s", "don't!", "'S 'LL x'RE.", "a<|endoftext|>b!", "!<|endoftext|>", "x=\u0338y", "3.14%", "a_b-c", "é.É", "No.5's", "K\u212a"]
    ids, n = tokens.WordIds(PATH).encode(pa.array(texts), 1)
    assert ids.tolist() == [i for t in texts for i in plain(t)]


def test_memory_of_words_is_bounded():
    coder = tokens.WordIds(PATH, most=3)
    for text in ("a b c d e", "f g a", "h i j k l"):
        assert coder.encode(pa.array([text]), 1)[0].tolist() == plain(text)


def test_round_trip(spark):
    rows = [(i * 7 % 8, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y"), (3, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tie string").repartition(3)
    folder = f"{shared_folder(spark)}/t"
    tokens.write(docs.drop("_tie").withColumn("start", docs.doc_id), folder, width="uint32")
    got = sorted((r.asDict() for r in tokens.read(spark, folder, width="uint32").collect()), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(len(rows)))
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(r[0] for r in rows if r[0] is not None)
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    crc = {}
    for i, t, _ in rows:
        crc.setdefault(i, []).append((len(plain(t)), zlib.crc32(np.array(plain(t), "<u4").tobytes())))
    for r in got:
        crc[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(crc.values())


def test_empty_table(spark):
    folder = f"{shared_folder(spark)}/t"
    tokens.write(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert tokens.read(spark, folder).collect() == []
