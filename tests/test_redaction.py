"""Redaction of texts that are no JSON, that are very deep, or that hide secrets in odd places."""

import json

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from platehouse.functions.redaction import MOST_DEPTH, redact, redacted

_JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 10**12) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text("abcé\"\\", max_size=5), c, max_size=4), max_leaves=20)


def _depth(x):
    return 1 + max(map(_depth, x.values() if isinstance(x, dict) else x), default=0) if isinstance(x, dict | list) else 0


@settings(max_examples=300, deadline=None)
@given(_JSON.filter(lambda x: _depth(x) <= MOST_DEPTH), st.booleans())
def test_plain_documents_stay(value, spaced):
    assert json.loads(redacted(json.dumps(value, indent=1 if spaced else None))) == value


@settings(max_examples=500, deadline=None)
@given(st.text('{}[],:"\\ab1.e-\n ', max_size=25))
def test_no_text_is_an_error(text):
    try:
        json.loads(text)
    except ValueError:
        assert redacted(text) == '"[UNSUPPORTED]"'
    else:
        json.loads(redacted(text))


@pytest.mark.parametrize(("text", "shown"), [
    ("", '"[UNSUPPORTED]"'), ("{", '"[UNSUPPORTED]"'), ("[1,]", '"[UNSUPPORTED]"'), ('{"a":1}}', '"[UNSUPPORTED]"'), ('{"a" 1}', '"[UNSUPPORTED]"'), ("[1}", '"[UNSUPPORTED]"'), (" [ ] ", "[]"),
    ('"http://[x y"', '"http://[x y"'), ('"HTTPS://h/p?a=http://u:p@x"', '"https://h/p"'), ('"http://u@h"', '"[REDACTED]"'), ('"http://h/@?x"', '"http://h/@"'),
    ('{"my_Secret_2":{"a":[1,{"b":2}]},"b":[{"PASSWORD":null}]}', '{"my_Secret_2":"[REDACTED]","b":[{"PASSWORD":"[REDACTED]"}]}'), ('{"\\u0074oken":1}', '{"\\u0074oken":"[REDACTED]"}'),
    ("[1e999,-1E400,1e5,NaN,-Infinity]", '["[NON_FINITE]","[NON_FINITE]",1e5,"[NON_FINITE]","[NON_FINITE]"]'), ('"\\ud800x"', '"\\ud800x"'), ('{"token":[[1],2],"n":[3]}', '{"token":"[REDACTED]","n":[3]}'),
])
def test_odd_texts(text, shown):
    assert redacted(text) == shown


def test_limits_within_muted_and_open_lists():
    wide = [0] * 1200
    assert json.loads(redacted(json.dumps({"a": [wide, [1]], "token": wide, "b": {f"k{i}": {"x": [i]} for i in range(1003)}, "c": 1}))) == {
        "a": [[0] * 1000 + ["[TRUNCATED]"], [1]], "token": "[REDACTED]", "b": {f"k{i}": {"x": [i]} for i in range(1000)} | {"_truncated": True}, "c": 1}


def test_one_bad_page_stops_nothing(spark):
    deep = "[" * 20_000 + "]" * 20_000
    rows = [(0, '{"a":1}'), (1, deep), (2, "{broken"), (3, None), (4, '{"u":"http://[x y"}'), (5, '"\\ud800"')]
    got = {r["i"]: r["d"] for r in spark.createDataFrame(rows, "i int, d string").select("i", redact(F.col("d")).alias("d")).collect()}
    assert got == {0: '{"a":1}', 1: "[" * 9 + '"[TRUNCATED]"' + "]" * 9, 2: '"[UNSUPPORTED]"', 3: None, 4: rows[4][1], 5: rows[5][1]}
