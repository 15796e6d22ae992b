"""Lenient JSON to JSON: what careless writers leave out or add is accepted, anything else gives null.

Accepted beside JSON: comments (# and // to the end of the line, /* */), single quotes, words without quotes as keys
and values, = or => for a colon, ; for a comma, empty places of arrays as null, and the line )]}' before a document.
Not accepted: a comma at an object's end, unknown escapes, what isn't closed, a second document, deep nesting.

A text is cut into tokens by one pattern and read with a stack, so depth costs no recursion.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Containers within each other, the guard line, escapes and what they stand for, plain numbers.
MOST_DEEP = 255
GUARD = ")]}'\n"
ESCAPED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", "\n": "\n", "'": "'", '"': '"', "\\": "\\", "/": "/"}
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", re.ASCII)
SAFE_INTEGER = 2**53 - 1

_ESCAPE = r"\\(?:u[0-9A-Fa-f]{4}|[tbnrf\n'\"\\/])"
_STOPS = r"/\;#={}\[\]:, \t\f\r\n"
_TOKEN = re.compile(
    rf"""(?P<blank>[ \t\n\r]++|(?:\#|//)[^\n\r]*+|/\*.*?\*/)
    |(?P<quoted>"[^"\\]*+(?:{_ESCAPE}[^"\\]*+)*+"|'[^'\\]*+(?:{_ESCAPE}[^'\\]*+)*+')
    |(?P<mark>[{{}}\[\]:,;]|=>?)
    |(?P<word>[^{_STOPS}"'][^{_STOPS}]*+)""",
    re.DOTALL | re.VERBOSE,
)
_ESCAPE_IN = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|(.))", re.DOTALL)
_LONE = re.compile("[\ud800-\udfff]")


class Refused(ValueError):
    """The text is outside of the accepted grammar."""


class Node:
    """An array's values, or an object's by key, in order."""

    __slots__ = ("items", "key", "keyed")

    def __init__(self, keyed: bool):
        self.keyed, self.items, self.key = keyed, {} if keyed else [], None

    def add(self, value) -> None:
        if self.keyed:
            self.items[self.key] = value
        else:
            self.items.append(value)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise Refused(f"no token at {at}")
        at = m.end()
        if m.lastgroup != "blank":
            yield m.lastgroup, m.group()


def _unquoted(raw: str) -> str:
    s = _ESCAPE_IN.sub(lambda m: chr(int(m[1], 16)) if m[1] else ESCAPED[m[2]], raw[1:-1]) if "\\" in raw else raw[1:-1]
    # Halves of a character, written as two escapes, become one.
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass") if _LONE.search(s) else s


def _scalar(kind: str, raw: str):
    """A str, bool or None, or a number as (raw,), which keeps its digits."""
    if kind == "quoted":
        return _unquoted(raw)
    low = raw.lower()
    if low in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[low]
    return (raw,) if NUMBER.fullmatch(raw) else raw


def read(text: str):
    """The document's value: a Node, str, bool, None or (number,). Raises Refused."""
    body = text[_leading_blank(text) :].removeprefix(GUARD)
    root = Node(False)
    open_, want = [root], "value"
    for kind, raw in _tokens(body):
        top = open_[-1]
        listed = not top.keyed and top is not root
        if want in ("value", "first") and listed and (raw in ",;" or raw == "]" and want == "value") and kind == "mark":
            top.add(None)
            want = "after"
        if want == "value" or want == "first" and raw not in "]}":
            if want == "first" and top.keyed:
                want = "key"
            elif kind == "mark" and raw in "{[":
                if len(open_) > MOST_DEEP:
                    raise Refused("too deep")
                node = Node(raw == "{")
                top.add(node)
                open_.append(node)
                want = "first"
                continue
            elif kind == "mark":
                raise Refused(f"{raw} for a value")
            else:
                top.add(_scalar(kind, raw))
                want = "after"
                continue
        if want == "key":
            if kind == "mark":
                raise Refused(f"{raw} for a key")
            top.key, want = _unquoted(raw) if kind == "quoted" else raw, "colon"
        elif want == "colon":
            if kind != "mark" or raw not in (":", "=", "=>"):
                raise Refused(f"{raw} for a colon")
            want = "value"
        elif top is root or kind != "mark":
            raise Refused(f"{raw} after a value")
        elif raw == ("}" if top.keyed else "]"):
            open_.pop()
            want = "after"
        elif raw in ",;" and want == "after":
            want = "key" if top.keyed else "value"
        else:
            raise Refused(f"{raw} after a value")
    if len(open_) > 1 or not root.items:
        raise Refused("not closed")
    return root.items[0]


def _leading_blank(text: str) -> int:
    """Where the first token may begin; the guard line is looked for there."""
    at = 0
    while (m := _TOKEN.match(text, at)) is not None and m.lastgroup == "blank":
        at = m.end()
    return at


def _quote(s: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def _leaf(v) -> str:
    return _quote(v) if isinstance(v, str) else v[0] if isinstance(v, tuple) else json.dumps(v)


def plain_json(v) -> str:
    """JSON without blanks; of keys that repeat the last value counts, at the first one's place."""
    if not isinstance(v, Node):
        return _leaf(v)
    if v.keyed:
        return "{" + ",".join(f"{_quote(k)}:{plain_json(x)}" for k, x in v.items.items()) + "}"
    return "[" + ",".join(map(plain_json, v.items)) + "]"


def pretty_json(v, indent: str = "") -> str | None:
    """JSON in lines, two blanks a level; None if a value has no one way to be written: nulls, numbers other than
    plain integers up to 2**53 - 1, and strings with line separators or characters beyond the first plane."""
    if isinstance(v, str):
        return None if any(c in "\u2028\u2029" or "\ud800" <= c <= "\udfff" or c > "\uffff" for c in v) else _quote(v)
    if isinstance(v, tuple):
        return v[0] if v[0].lstrip("-").isdigit() and abs(int(v[0])) <= SAFE_INTEGER else None
    if not isinstance(v, Node):
        return None if v is None else json.dumps(v)
    ends = "{}" if v.keyed else "[]"
    inner = indent + "  "
    parts = []
    for k in v.items:
        head = pretty_json(k) if v.keyed else ""
        x = pretty_json(v.items[k] if v.keyed else k, inner)
        if head is None or x is None:
            return None
        parts.append(f"{inner}{head}: {x}" if v.keyed else inner + x)
    return ends[0] + "\n" + ",\n".join(parts) + "\n" + indent + ends[1] if parts else ends


def _over(texts: pd.Series, write) -> pd.Series:
    def one(text):
        try:
            return None if text is None else write(read(text))
        except Refused:
            return None

    return pd.Series([one(s) for s in texts], dtype="object")


@F.pandas_udf(T.StringType())
def to_json(texts: pd.Series) -> pd.Series:
    """A text's JSON without blanks, for from_json or JSON paths; null for null and for what isn't accepted.

    A half of a character alone is kept as its escape. Empty texts are no document.
    """
    return _over(texts, plain_json)


@F.pandas_udf(T.StringType())
def to_pretty(texts: pd.Series) -> pd.Series:
    """As to_json, in lines; null also for documents that pretty_json can't write."""
    return _over(texts, pretty_json)
