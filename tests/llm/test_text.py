import re

import numpy as np
import pyarrow as pa

from tracewright.llm import _text

TEXTS = ["The cat  sat\ton", None, "", "one", " \n ", "é É ABC\x0babc", "a b c d a b c", "x" * 50 + " " + "y" * 70]


def test_words_match_regex_and_hash_by_content():
    hashes, first = _text.word_hashes(pa.array(TEXTS))
    seen = {}
    for i, text in enumerate(TEXTS):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x20\x09-\x0d]+", lower)
        own = hashes[first[i] : first[i + 1]]
        assert len(own) == len(words)
        for w, h in zip(words, own):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_cross_chunks(monkeypatch):
    monkeypatch.setattr(_text, "_CHUNK", 16)
    small, _ = _text.word_hashes(pa.array(TEXTS))
    monkeypatch.setattr(_text, "_CHUNK", 1 << 20)
    large, _ = _text.word_hashes(pa.array(TEXTS))
    assert np.array_equal(small, large)


def test_shingles():
    words, first = _text.word_hashes(pa.array(["a b c d", "a b", "", "a b c", "b c d"]))
    s, at = _text.shingle_hashes(words, first, 3)
    assert list(np.diff(at)) == [2, 1, 0, 1, 1]
    assert s[0] == s[3] and s[1] == s[4] and len(set(s.tolist())) == 3


def test_slices_keep_all_rows():
    batch = pa.record_batch({"text": pa.array(["ab" * 10] * 7 + [None])})
    got = [b.num_rows for b in _text.slices([batch], most=45)]
    assert sum(got) == 8 and max(got) <= 3
