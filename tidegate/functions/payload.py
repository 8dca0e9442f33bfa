"""JSON payloads as text: canonical form and hash, structural policy, raw tokens of fields, error codes.

Spark's own JSON functions normalise numbers and strings, so these work on the text, in Arrow batches.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F

from ..shipping import ship

# Limits of a command's payload.
DEPTH, NODES, PROPERTIES, BYTES = 31, 4089, 128, 61_440
_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|([{}\[\],:]))', re.S)
# Characters that the writer escapes although JSON does not ask for it.
_ESCAPED = set("\"\\'<>&+`") | {chr(0x7F)}
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", "\\": "\\\\"}


class Raw(str):
    """A number or literal, as it was written."""


def parse(text: str):
    """Objects as lists of (name, value) pairs in a tuple tagged 'o', arrays tagged 'a', strings, and Raw tokens.

    An explicit stack: nesting is bounded by memory only, and the policy can judge any depth."""
    at, stack, root = 0, [], []
    top, kind, name, want = root, "r", None, "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
        string, plain, mark = m.groups()
        if string is not None and kind == "o" and want == "name":
            name, want = json.loads(string), "colon"
            continue
        if mark == ":" and want == "colon":
            want = "value"
            continue
        if mark == "," and want == "next" and kind != "r":
            want = "name" if kind == "o" else "value"
            continue
        if mark in ("}", "]"):
            if not stack or (mark == "}") != (kind == "o") or (want not in ("next", "first") and not (want == "name" and not top)):
                raise ValueError(f"unexpected {mark} at {at}")
            top, kind, name = stack.pop()
            want = "next"
            continue
        if want not in ("value", "first") or mark in (":", ","):
            raise ValueError(f"unexpected token at {at}")
        value = json.loads(string) if string is not None else Raw(plain) if plain is not None else ("o" if mark == "{" else "a", [])
        top.append((name, value) if kind == "o" else value)
        if mark:
            stack.append((top, kind, name))
            top, kind, name = value[1], value[0], None
            want = "name" if kind == "o" else "first"
        else:
            want = "next"
    if text[at:].strip() or stack or len(root) != 1:
        raise ValueError(f"not JSON at {at}")
    return root[0]


def _quote(s: str) -> str:
    out = []
    for c in s:
        if c in _SHORT:
            out.append(_SHORT[c])
        elif c < " " or c in _ESCAPED or c > "~":
            out += [f"\\u{unit:04X}" for unit in _units(c)]
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


def _units(s: str) -> list[int]:
    data = s.encode("utf-16-be", "surrogatepass")
    return [data[i] << 8 | data[i + 1] for i in range(0, len(data), 2)]


def canonical(value) -> str:
    """Names in the order of their UTF-16 units, arrays as they are, numbers as written."""
    if isinstance(value, Raw):
        return str(value)
    if isinstance(value, str):
        return _quote(value)
    kind, items = value
    if kind == "a":
        return "[" + ",".join(map(canonical, items)) + "]"
    return "{" + ",".join(_quote(k) + ":" + canonical(x) for k, x in sorted(items, key=lambda i: _units(i[0]))) + "}"


def hash_of(text: str | None) -> str | None:
    """Base64 of the SHA-256 of the canonical form; null for null or broken JSON."""
    try:
        return None if text is None else base64.b64encode(hashlib.sha256(canonical(parse(text)).encode()).digest()).decode()
    except ValueError:
        return None


def judge(text: str | None) -> str:
    """'ok', or the first rule that the payload breaks."""
    if text is None:
        return "PAYLOAD_MISSING"
    try:
        root = parse(text)
    except ValueError:
        return "JSON_INVALID"
    todo, nodes = [(root, 1)], 0
    while todo:
        value, depth = todo.pop()
        nodes += 1
        if isinstance(value, str):
            if any(0xD800 <= ord(c) < 0xE000 for c in value):
                return "TEXT_INVALID"
            continue
        if depth > DEPTH:
            return "TOO_DEEP"
        kind, items = value
        if kind == "o":
            if len(items) > PROPERTIES:
                return "TOO_MANY_PROPERTIES"
            if len({k.upper() for k, _ in items}) < len(items):
                return "NAMES_AMBIGUOUS"
            nodes += len(items)
        todo += [(x[1] if kind == "o" else x, depth + 1) for x in items]
        if nodes + len(todo) > NODES:
            return "TOO_MANY_NODES"
    return "ok" if len(canonical(root).encode()) <= BYTES else "TOO_LARGE"


def token_of(text: str | None, name: str) -> str | None:
    """Raw text of a field of the top object: 1, 1.0 and \"1\" are three different tokens."""
    try:
        root = parse(text) if text is not None else None
    except ValueError:
        return None
    if not isinstance(root, tuple) or root[0] != "o":
        return None
    found = [x for k, x in root[1] if k == name]
    return canonical(found[-1]) if found else None


_CODE = re.compile("[A-Z0-9_]{1,64}")
_BLANK = re.compile(r"[ \t\r\n]*")


def _members(text: str, at: int):
    """(name, place of the value) of an object's members, from its opening brace, as far as the text goes."""
    from json.decoder import scanstring

    decoder = json.JSONDecoder()
    skip = lambda i: _BLANK.match(text, i).end()
    at = skip(at + 1)
    while text[at : at + 1] == '"':
        name, at = scanstring(text, at + 1)
        at = skip(at)
        if text[at : at + 1] != ":":
            return
        at = skip(at + 1)
        yield name, at
        at = skip(decoder.raw_decode(text, at)[1])
        if text[at : at + 1] != ",":
            return
        at = skip(at + 1)


def error_code(body: str | None) -> str | None:
    """Code of an error body: the string `code` of the top object, or of `error` one level down, whichever comes first.

    Only the first 4096 bytes count, so a body may be cut off behind the code. One that is not well formed is none.
    """
    from json.decoder import scanstring

    text = (body or "").encode("utf-8", "replace")[:4096].decode("utf-8", "ignore")

    def string(at: int) -> str | None:
        found = scanstring(text, at + 1)[0] if text[at : at + 1] == '"' else ""
        return found if _CODE.fullmatch(found) else None

    try:
        start = _BLANK.match(text).end()
        if text[start : start + 1] != "{":
            return None
        for name, at in _members(text, start):
            if name == "code":
                return string(at)
            if name == "error" and text[at : at + 1] == "{":
                for inner, place in _members(text, at):
                    if inner == "code":
                        return string(place)
    except ValueError:
        pass
    return None


def _udf(spark, f, kind: str = "string"):
    ship(spark)

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action=None)

    return run


def payload_hash(spark):
    return _udf(spark, hash_of)


def policy(spark):
    return _udf(spark, judge)


def raw_token(spark, name: str):
    return _udf(spark, lambda t: token_of(t, name))


def error_codes(spark):
    return _udf(spark, error_code)
