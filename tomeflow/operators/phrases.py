"""Text conversion by a table of phrases: at each place the longest phrase that begins there is replaced, what it
covers is passed over, and characters that begin none stay."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases, and characters of all of them, up to which the table goes to every task.
MOST_PHRASES, MOST_CHARS = 200_000, 4_000_000
#: Characters of all phrases, and of one, up to which the table is one pattern.
PATTERN_CHARS, PATTERN_PHRASE = 200_000, 64

_VALUE = ""  # key of a trie's node under which a phrase that ends there has its value


def trie(pairs) -> dict:
    root: dict = {}
    for phrase, value in pairs:
        node = root
        for c in phrase:
            node = node.setdefault(c, {})
        node[_VALUE] = value
    return root


def pattern(root: dict) -> re.Pattern:
    """Of a trie: it matches, where a phrase begins, the longest one."""

    def after(node: dict) -> str:
        ways = []
        for c, below in node.items():
            if c == _VALUE:
                continue
            run = [c]
            while len(below) == 1 and _VALUE not in below:  # a phrase's only way on needs no group
                ((c, below),) = below.items()
                run.append(c)
            ways.append(re.escape("".join(run)) + after(below))
        return f"(?:{'|'.join(ways)}){'?' if _VALUE in node else ''}" if ways else ""

    return re.compile(after(root) or r"(?!)")


def replaced(text: str, root: dict, begins: re.Pattern) -> str:
    """text with phrases of the trie replaced; begins finds a phrase's first character."""
    out, done = [], 0
    while (m := begins.search(text, done)) is not None:
        start = at = m.start()
        out.append(text[done:start])
        node, best, done = root, text[start], start + 1
        while at < len(text) and (node := node.get(text[at])) is not None:
            at += 1
            if _VALUE in node:
                best, done = node[_VALUE], at
        out.append(best)
    out.append(text[done:])
    return "".join(out)


def replacer(pairs: list[tuple[str, str]]) -> Callable[[str], str]:
    """What replaces phrases in a text: by one pattern of all, or for tables too large to be one by walks of the trie."""
    root = trie(pairs)
    if sum(len(p) for p, _ in pairs) <= PATTERN_CHARS and max((len(p) for p, _ in pairs), default=0) <= PATTERN_PHRASE:
        found, values = pattern(root), dict(pairs)
        return lambda s: found.sub(lambda m: values[m[0]], s)
    begins = re.compile(f"[{re.escape(''.join(sorted(root)))}]" if root else r"(?!)")
    return lambda s: replaced(s, root, begins)


def _table(table: DataFrame, phrase: str, value: str) -> DataFrame:
    """(phrase, value): of a phrase with several values the least; empty phrases and nulls have no part in it."""
    x = table.select(F.col(phrase).alias("phrase"), F.col(value).alias("value")).where("phrase <> '' and value is not null")
    return x.groupBy("phrase").agg(F.min("value").alias("value"))


def convert(rows: DataFrame, key: str, text: str, out: str, table: DataFrame, phrase: str, value: str, most: int = MOST_PHRASES) -> DataFrame:
    """rows with out, the converted text; null for null. A column of the name of out is replaced.

    A table within its bounds goes to every task as a trie, and nothing is shuffled. A larger one is joined to the
    texts' substrings of its phrases' lengths; then keys tell rows apart, are expected once, and texts of null ones come out null.
    """
    t = _table(table, phrase, value)
    size = t.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("phrase") + F.char_length("value")), F.lit(0)).alias("chars")).first()
    if size.n > most or size.chars > MOST_CHARS:
        return _joined(rows, key, text, out, t)
    pairs = [(r.phrase, r.value) for r in t.collect()]  # within the bounds above
    shared = rows.sparkSession.sparkContext.broadcast(pairs)

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        put = replacer(shared.value)
        for texts in batches:
            yield pd.Series([None if s is None else put(s) for s in texts], dtype="object")

    return rows.withColumn(out, run(F.col(text)))


@F.pandas_udf(T.StringType())
def _put(texts: pd.Series, found: pd.Series) -> pd.Series:
    """Texts with (at, n, value) in order of place, the longest first, put in; those in what is covered don't count."""

    def one(s, matches):
        if s is None or matches is None:
            return s
        out, done = [], 0
        for m in matches:
            if m["at"] >= done:
                out += (s[done : m["at"]], m["value"])
                done = m["at"] + m["n"]
        return "".join(out) + s[done:]

    return pd.Series([one(s, m) for s, m in zip(texts, found, strict=True)], dtype="object")


def _joined(rows: DataFrame, key: str, text: str, out: str, table: DataFrame) -> DataFrame:
    sizes = F.broadcast(table.select(F.char_length("phrase").alias("n")).distinct().agg(F.collect_set("n").alias("sizes")))  # lengths
    x = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).join(sizes)
    # A place and a length are a row, and one text's equal substrings one row with all of their places.
    one = x.select("key", "text", F.explode("sizes").alias("n")).where(F.col("n") <= F.char_length("text"))
    one = one.select("key", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.char_length("text") - F.col("n") + 1), lambda i: F.substring("text", i, F.col("n")))).alias("at", "phrase"))
    met = one.join(table, "phrase").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "value"))).alias("m"))  # a text's matches
    met = met.select(F.col("key").alias("__key"), F.transform("m", lambda m: F.struct(m["at"].alias("at"), (-m["less"]).alias("n"), m["value"].alias("value"))).alias("__m"))
    keyed = rows.withColumn("__key", F.col(key)).join(met, "__key", "left")
    converted = keyed.withColumn(out, F.when(F.col(key).isNotNull(), _put(F.col(text), F.col("__m"))))
    return converted.drop("__key", "__m")
