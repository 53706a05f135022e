"""Configuration formats there and back, and what is refused."""

import tomllib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.sources import formats as X

TEXT = st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc")), max_size=12) | st.sampled_from(["true", "~", "1.5", "a: b", "- x", "#", "it's", 'q"', "a\nb", "\ttab", " pad ", "", "null", "é"])
SCALAR = TEXT | st.integers(-(2**40), 2**40) | st.booleans() | st.floats(allow_nan=False, allow_infinity=False, width=32).map(lambda f: round(f, 3))
NESTED = st.recursive(SCALAR, lambda v: st.lists(v, max_size=3) | st.dictionaries(TEXT.filter(lambda k: k not in X._FORBIDDEN), v, max_size=3), max_leaves=10)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(TEXT.filter(bool), NESTED, max_size=4))
def test_toml_there_and_back(value):
    assert tomllib.loads(X.to_toml(value)) == value


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(TEXT.filter(bool), NESTED, max_size=4))
def test_yaml_there_and_back(value):
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load(X.to_yaml(value)) == value


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a: &x 1\nb: *x", "a: !!python/object:os.system 1", "a:\n  b: 1\n  b: 2"])
def test_yaml_guards(text):
    pytest.importorskip("yaml")
    with pytest.raises(ValueError):
        X.parse_yaml(text)


def test_insert_set():
    rows = X.parse_inserts("INSERT INTO t SET a = 1, `b` = 'it''s, x', c = NULL, d = now();\nREPLACE INTO u (a) VALUES (2);")
    assert {r["table"]: r["row"] for r in rows} == {"t": {"a": 1, "b": "it's, x", "c": None, "d": "[SQL expression: now()]"}, "u": {"a": 2}}


def test_rows_as_documents(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('x', array(1, 2), 'y', CAST(NULL AS STRING)) AS s")
    assert tomllib.loads(X.to_texts(df, "toml").first()["text"]) == {"id": 1, "s": {"x": [1, 2]}}
    assert X.to_texts(df, "yaml").first()["text"] == "id: 1\ns:\n  x:\n    - 1\n    - 2\n  \"y\": null\n"
