"""Rules that read a page step by step, compiled once and run over a page that is parsed once.

A rule is XPath (it begins with / or @xpath:), a selector (@css:), or steps parted by @, the last of which tells what
is taken: `class.list@tag.li.0@tag.a@text`. A step is a selector, or tag.x, class.x y, id.x, text.x (elements whose
own text has x) or children, and may end in places: .n, .a:b (up to b), !a:b:c (all but these), [a,b], [a:b], [a:b:c]
(from, to and including, by), [!a,b]; negative ones count from the end. Each step looks below what the step before
has found; where nothing below fits, elements that fit themselves stay.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import xpath
from .markup import Node, compile_selector, find, fits, parse, squeeze

_PLAIN = re.compile(r"[A-Za-z][\w-]*")
_KEYWORD = re.compile(r"(tag|class|id|text)\.(.+)", re.S)
_BRACKET = re.compile(r"(.*[^\s])\s*\[\s*(!?)([-\d:,\s]+)\]", re.S)
_SUFFIX = re.compile(r"(.*?)(?:!(?P<but>-?\d+(?::-?\d+)*)|\.(?P<a>-?\d+):(?P<b>-?\d+)|\.(?P<n>-?\d+))\s*", re.S)

Places = Callable[[int], list[int]]


def _spans(items: str) -> Places:
    """Places that a list like 1, -2, 0:4:2 names, each once, in the order it names them."""
    parsed = [[int(x) if x.strip() else None for x in item.split(":")] for item in items.split(",")]
    if any(len(p) > 3 or len(p) == 3 and p[2] is None or p == [None] for p in parsed):
        raise ValueError(f"unsupported places: [{items}]")

    def places(n: int) -> list[int]:
        out: dict[int, None] = {}
        for p in parsed if n else []:
            if len(p) == 1:
                i = p[0] + n if p[0] < 0 else p[0]
                out |= {i: None} if 0 <= i < n else {}
                continue
            a, b = (x + n if x < 0 else x for x in (0 if p[0] is None else p[0], n - 1 if p[1] is None else p[1]))
            if max(a, b) < 0 or min(a, b) >= n:
                continue  # wholly outside on one side
            a, b = (min(max(x, 0), n - 1) for x in (a, b))
            by = p[2] if len(p) == 3 else 1
            by = by if by > 0 else by + n if by + n > 0 else 1
            out |= dict.fromkeys(range(a, b + 1, by) if b >= a else range(a, b - 1, -by))
        return list(out)

    return places


def _suffix(raw: str) -> tuple[str, Places | None]:
    """A step without its places, and which of n elements they keep."""
    if m := _BRACKET.fullmatch(raw):
        chosen = _spans(m[3])
        rest = m[1].removesuffix(".") if _KEYWORD.match(m[1]) else m[1]
        return rest, (lambda n: [i for i in range(n) if i not in set(chosen(n))]) if m[2] else chosen
    m = _SUFFIX.fullmatch(raw)
    if m is None or not m[1].strip():
        return raw, None
    rest = m[1].strip().removesuffix(".") if _KEYWORD.match(m[1].strip()) or m[1].strip() == "children." else m[1].strip()
    if m["but"] is not None:
        but = [int(x) for x in m["but"].split(":")]
        return rest, lambda n: [i for i in range(n) if i not in {x + n if x < 0 else x for x in but}]
    if m["n"] is not None:
        return rest, _spans(m["n"])
    a, b = int(m["a"]), int(m["b"])
    return rest, lambda n: list(range(n))[slice(a, b)]


Find = Callable[[list[Node]], list[Node]]


def compile_step(raw: str) -> Find:
    """What a step finds below a list of elements."""
    name, places = _suffix(raw.strip())
    pick = lambda x: x if places is None else [x[i] for i in places(len(x))]
    if name == "children":
        return lambda scope: [c for n in scope for c in pick(n.elements())]
    m = _KEYWORD.fullmatch(name)
    if m and m[1] == "text":
        chains, own = compile_selector("*"), m[2]
        return lambda scope: pick([n for n in _below(scope, chains) if own in n.own_text()])
    # Keywords also stand inside a selector of several elements.
    name = re.sub(r"(^|\s)tag\.(?=[A-Za-z])", r"\1", name)
    name = re.sub(r"(^|\s)id\.(?=[\w-])", r"\1#", name)
    name = re.sub(r"(^|\s)class\.([\w-]+(?:\s+[\w-]+)*)", lambda m: m[1] + "".join("." + c for c in m[2].split()), name)
    chains = compile_selector(name)

    def run(scope: list[Node]) -> list[Node]:
        found = _below(scope, chains)
        return pick(found or [n for n in scope if any(fits(n, c, len(c) - 1, None) for c in chains)])

    return run


def _below(scope: list[Node], chains: list) -> list[Node]:
    """What lies below any of scope, each once, in document order."""
    if len(scope) == 1:
        return find(scope[0], chains)
    found = {id(n): n for s in scope for n in find(s, chains)}
    return sorted(found.values(), key=lambda n: n.order)


def taken(node: Node, what: str) -> str | None:
    """What a rule's last step takes of an element."""
    if what in ("", "text"):
        return squeeze(node.text())
    if what == "ownText":
        return squeeze(node.own_text())
    if what == "textNodes":
        return "\n".join(filter(None, (squeeze(c.data) for c in node.children if c.tag == "#text")))
    if what in ("html", "all"):
        return node.html() if what == "html" else node.outer()
    return node.attrs.get(what.lower())


def _split(rule: str) -> list[str]:
    """Parts of a rule between @ that stand outside brackets and quotes."""
    out, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(rule):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "@" and not depth:
            out.append(rule[last:i])
            last = i + 1
    return [*out, rule[last:]]


class Rule:
    """A compiled rule: nodes(scope) are the elements it finds, values(scope) the texts."""

    def __init__(self, rule: str):
        self.path, self.steps, self.what, self.place = None, [], "", None
        low = rule.strip()
        if low.startswith(("/", "./")) or low.lower().startswith("@xpath:"):
            text = low[7:] if low.lower().startswith("@xpath:") else low
            selector = xpath.to_selector(text)
            if selector is None:
                self.path = xpath.compile_xpath(text)
            else:
                self.steps = [lambda scope, c=compile_selector(selector): _below(scope, c)]
            return
        css = low.lower().startswith("@css:")
        parts = _split(low[5:] if css else low)
        last, _, place = parts[-1].partition("!")
        if _PLAIN.fullmatch(last.strip()) and (place == "" or re.fullmatch(r"-?\d+", place)) and (len(parts) > 1 or last.strip() in ("text", "ownText", "textNodes", "html", "all")):
            self.what, self.place, parts = last.strip(), int(place) if place else None, parts[:-1]
        parts = [p for p in parts if p.strip()]
        if not parts and not self.what:
            raise ValueError(f"empty rule: {rule}")
        if css and parts:
            chains = compile_selector("@".join(parts))
            self.steps = [lambda scope: _below(scope, chains)]
        else:
            self.steps = [compile_step(p) for p in parts]

    def nodes(self, scope: Node) -> list[Node]:
        if self.path is not None:
            return [n for n in xpath.nodes(self.path, scope) if n.tag[:1] not in ("#", "@")]
        found = [scope]
        for step in self.steps:
            found = step(found)
        return found

    def values(self, scope: Node) -> list[str]:
        if self.path is not None:
            return xpath.values(self.path, scope)
        out = [v for n in self.nodes(scope) if (v := taken(n, self.what)) is not None]
        if self.place is None:
            return out
        return [out[self.place]] if -len(out) <= self.place < len(out) else []


rule = functools.lru_cache(1024)(Rule)


def values_of(html: str | None, rules: list[str]) -> list[list[str] | None]:
    """Values of several rules on one page, parsed once; a rule that fails on it gives none and spares the others."""
    compiled = [rule(r) for r in rules]
    page, out = parse(html or ""), []
    for r in compiled:
        try:
            out.append(r.values(page))
        except (ValueError, RecursionError):
            out.append(None)
    return out


def find_values(html: Column, rules: list[str]) -> Column:
    """An array of values for each rule, null where it failed; rules are compiled here, so that errors show at once."""
    for r in rules:
        rule(r)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([values_of(h, rules) for h in b], dtype=object)

    return run(html)


def _typed(text: str | None, kind: T.DataType):
    if text is None or isinstance(kind, T.StringType):
        return text
    return int(text.strip()) if isinstance(kind, T.LongType) else float(text.strip())


class PageRows:
    """Table function (html, rows, fields): a row for each element that the rule `rows` finds.

    fields: JSON, name to rule or [rule, "bigint" or "double"], read within the element; a field is the first value
    that isn't blank, or null. error names the fields that failed in a row (a rule that could not be evaluated, a
    number that is none); the other fields of the row are kept.
    """

    @staticmethod
    def analyze(html, rows, fields):
        from pyspark.sql.udtf import AnalyzeResult

        schema = T.StructType().add("item_no", T.IntegerType())
        Rule(rows.value)
        for name, r in json.loads(fields.value).items():
            Rule(r if isinstance(r, str) else r[0])
            schema = schema.add(name, T.StringType() if isinstance(r, str) else {"bigint": T.LongType(), "double": T.DoubleType()}[r[1]])
        return AnalyzeResult(schema=schema.add("error", T.StringType()))

    def eval(self, html: str, rows: str, fields: str):
        kinds = {"bigint": T.LongType(), "double": T.DoubleType()}
        wanted = _fields(fields)
        try:
            items = rule(rows).nodes(parse(html or ""))
        except (ValueError, RecursionError):
            items = []
        for i, item in enumerate(items):
            out, failed = [], []
            for name, r, kind in wanted:
                try:
                    found = next((v for v in rule(r).values(item) if v.strip()), None)
                    out.append(_typed(found, kinds.get(kind, T.StringType())))
                except (ValueError, RecursionError):
                    out.append(None)
                    failed.append(name)
            yield (i, *out, ",".join(failed) or None)


@functools.lru_cache(64)
def _fields(fields: str) -> list[tuple[str, str, str]]:
    return [(name, r, "string") if isinstance(r, str) else (name, *r) for name, r in json.loads(fields).items()]


def register(spark: SparkSession, name: str = "page_rows") -> None:
    """Make PageRows a table function of SQL, to be joined LATERAL."""
    spark.udtf.register(name, F.udtf(PageRows))


def page_rows(pages: DataFrame, html: str, rows: str, fields: dict) -> DataFrame:
    """pages' columns but html, beside the rows that the table function makes of each page."""
    spark = pages.sparkSession
    register(spark)
    keep = [c for c in pages.columns if c != html]
    call = "page_rows(html => p.`{}`, rows => :rows, fields => :fields)".format(html)
    return spark.sql(f"SELECT {', '.join(f'p.`{c}`' for c in keep)}{', ' if keep else ''}r.* FROM {{pages}} p, LATERAL {call} r", args={"rows": rows, "fields": json.dumps(fields)}, pages=pages)
