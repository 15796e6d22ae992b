"""Extraction rules over HTML and JSON columns, compiled to column expressions.

A rule reads, from loose to tight: branches parted by || (first that isn't blank), parts parted by && (joined
by line ends), a template with {{$.path}} holes, and a source with an optional ##pattern##replacement suffix.
Sources: $.path (JSON, see jsonpath), :regex (first group of a match), or a page rule (see pagerules) such as
`article h1@text`, `class.list@tag.li.0@href` and `//nav//a/@href`. JSON, regex and templates stay in built-in
functions; only page rules run in Python, over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jsonpath, pagerules
from .markup import parse

#: Elements whose begin and end break a line of text.
BLOCK = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|blockquote"


def select(html: str, selector: str) -> list[str]:
    """Values that a page rule finds, in document order; see pagerules for how rules are written."""
    return pagerules.rule(selector).values(parse(html or ""))


def select_all(html: Column, selector: str) -> Column:
    """All values that the rule finds, in document order; none on a page that it fails on."""
    return F.coalesce(F.get(pagerules.find_values(html, [selector]), 0), F.array().cast("array<string>"))


def split_outside(rule: str, by: str) -> list[str]:
    """Parts of a rule between separators that stand outside brackets and quotes; all of them if those don't close."""
    out, depth, quote, last, i = [], 0, "", 0, 0
    while i < len(rule):
        c = rule[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and rule.startswith(by, i):
            out.append(rule[last:i])
            last = i = i + len(by)
            continue
        i += 1
    return rule.split(by) if depth or quote else [*out, rule[last:]]


def _is_page_rule(source: str) -> bool:
    return not source.startswith(("$", ":")) and ("@" in source or source.startswith(("/", "./")))


def page_sources(rule: str) -> list[str]:
    """The sources of a rule that read a page."""
    out = []
    for branch in split_outside(rule, "||"):
        for part in split_outside(branch, "&&"):
            source = part.split("##")[0]
            out += [p for p in (re.findall(r"\{\{(.*?)\}\}", source) if "{{" in source else [source]) if _is_page_rule(p)]
    return out


def _source(rule: str, c: Column, found: dict[str, Column]) -> Column:
    if rule in found:
        return F.get(found[rule], 0)
    if rule.startswith("$"):
        return jsonpath.find(c, rule)
    if rule.startswith(":"):
        return F.nullif(F.regexp_extract(c, rule[1:], 1), F.lit(""))
    if _is_page_rule(rule):
        return F.get(select_all(c, rule), 0)
    return F.lit(rule)


def compile_rule(rule: str, c: Column, found: dict[str, Column] | None = None) -> Column:
    """The value that a rule finds in a column; null if it finds nothing. found: values of sources read before."""
    found = found or {}
    branches = split_outside(rule, "||")
    if len(branches) > 1:
        return F.coalesce(*[F.nullif(F.btrim(compile_rule(b, c, found)), F.lit("")) for b in branches])
    parts = split_outside(rule, "&&")
    if len(parts) > 1:
        found = F.array(*[F.nullif(F.btrim(compile_rule(p, c, found)), F.lit("")) for p in parts])
        return F.nullif(F.array_join(F.array_compact(found), "\n"), F.lit(""))
    source, *suffix = rule.split("##")
    if "{{" in source:
        pieces = re.split(r"\{\{(.*?)\}\}", source)
        value = F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(_source(p, c, found), F.lit("")) for i, p in enumerate(pieces) if p])
    else:
        value = _source(source, c, found)
    if suffix:
        value = F.regexp_replace(value, suffix[0], suffix[1] if len(suffix) > 1 else "")
    return value


def extract(pages: DataFrame, c: str, fields: dict[str, str], core: tuple[str, ...] = ()) -> DataFrame:
    """pages with a column for each rule; rows that miss a core field go. A page is parsed once for all fields."""
    sources = sorted({p for r in fields.values() for p in page_sources(r)})
    found = pagerules.find_values(F.col(c), sources) if sources else None
    read = {p: F.get(found, i) for i, p in enumerate(sources)}
    out = pages.select("*", *[compile_rule(r, F.col(c), read).alias(n) for n, r in fields.items()])
    for n in core:
        out = out.where(F.col(n).isNotNull() & (F.btrim(n) != ""))
    return out


def regex_rows(df: DataFrame, c: str, pattern: str, groups: int, names: list[str]) -> DataFrame:
    """A row for each match of a pattern, with its groups."""
    found = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]
    zipped = F.arrays_zip(*[f.alias(n) for f, n in zip(found, names, strict=True)])
    return df.select("*", F.posexplode(zipped).alias("item_no", "item")).select(*df.columns, "item_no", *[F.col(f"item.{n}").alias(n) for n in names])


def html_to_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments dropped (unclosed ones to the end), blocks on lines of their own,
    entities decoded. Only what is named like a tag is taken for one, so that a < b stays."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(</\1\s*>|\z)|<!--.*?(-->|\z)", "")
    x = F.regexp_replace(x, rf"(?i)</?(?:{BLOCK})\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"</?[A-Za-z][A-Za-z0-9-]*(\s[^<>]*)?/?>|<![A-Za-z][^>]*>", "")

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: t if t is None else unescape(t))

    x = decode(x)
    x = F.regexp_replace(x, "[\\u200b\\u200c\\u200d\\ufeff]", "")
    lines = F.filter(F.transform(F.split(x, "\n"), lambda s: F.btrim(F.regexp_replace(s, "[ \\t\\r\\u00a0]+", " "))), lambda s: s != "")
    return F.array_join(lines, "\n")
