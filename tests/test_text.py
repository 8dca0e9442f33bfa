import base64
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidegate.functions import payload as p
from tidegate.sources import pages


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20))
def test_canonical_is_json_of_the_same_value(value):
    import json

    text = json.dumps(value, ensure_ascii=False)
    out = p.canonical(p.parse(text))
    assert json.loads(out) == value and out.isascii()
    assert p.canonical(p.parse(out)) == out


def test_numbers_keep_their_text_and_names_are_sorted():
    assert p.canonical(p.parse(' {"b": 1.50, "a": [1e2, "x<"]} ')) == '{"a":[1e2,"x\\u003C"],"b":1.50}'
    assert p.hash_of('{"b":1,"a":2}') == base64.b64encode(hashlib.sha256(b'{"a":2,"b":1}').digest()).decode()
    assert p.hash_of('{"b":1') is None and p.hash_of(None) is None
    assert (p.token_of('{"k": 1}', "k"), p.token_of('{"k": 1.0}', "k"), p.token_of('{"k": "1"}', "k"), p.token_of("[1]", "k")) == ("1", "1.0", '"1"', None)


@pytest.mark.parametrize(
    ("text", "code"),
    [
        (None, "PAYLOAD_MISSING"),
        ("{", "JSON_INVALID"),
        ("[1,]", "JSON_INVALID"),
        ('{"a":1 "b":2}', "JSON_INVALID"),
        ("[" * 31 + "]" * 31, "ok"),
        ("[" * 32 + "]" * 32, "TOO_DEEP"),
        ('{"a":1,"A":2}', "NAMES_AMBIGUOUS"),
        ("{" + ",".join(f'"p{i}":1' for i in range(128)) + "}", "ok"),
        ("{" + ",".join(f'"p{i}":1' for i in range(129)) + "}", "TOO_MANY_PROPERTIES"),
        ("[" + ",".join(["1"] * 4088) + "]", "ok"),
        ("[" + ",".join(["1"] * 4089) + "]", "TOO_MANY_NODES"),
        ('["' + "x" * 62000 + '"]', "TOO_LARGE"),
        ('["\\ud800"]', "TEXT_INVALID"),
    ],
)
def test_policy(text, code):
    assert p.judge(text) == code


def test_error_codes():
    assert p.error_code('{"error":{"code":"ITEM_LOCKED","x":') == "ITEM_LOCKED"
    assert p.error_code('{"code":"lower"}') is None and p.error_code(None) is None


@pytest.mark.parametrize("body", ['[{"a":1}]', '{"value":[{"a":1}]}', '{"d":[{"a":1}]}', '{"d":{"results":[{"a":1}]}}', '﻿{"value":[{"a":1}]}'])
def test_shapes(body):
    assert pages.raw_rows(body) == ['{"a":1}']


@pytest.mark.parametrize(("body", "code"), [("{}", "ODATA_JSON"), ("[1]", "ODATA_JSON"), ("[", "ODATA_JSON"), ('[{"a":"' + "x" * 99 + '"}]', "ODATA_LIMIT")])
def test_bad_pages(body, code):
    with pytest.raises(pages.PageError) as e:
        pages.raw_rows(body, row_bytes=64)
    assert e.value.code == code


def test_counts():
    assert [pages.count_of(x) for x in ("42", "﻿7\r\n", "0")] == [42, 7, 0]
    with pytest.raises(pages.PageError):
        pages.count_of("-1")
