"""Line-first cleaning with DataFrame functions only.

Each line of a text is judged by punctuation, navigation and boilerplate rules; lines that fail are removed,
and a document is rejected when too much of its text went with them, or when its base rules fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

#: Phrases of boilerplate lines (lower case).
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here to",
    "lorem ipsum",
    "powered by",
)
#: Marks that part the entries of a navigation line, as words of their own.
NAV_MARKS = "[|»«>/•·]"
SPACES = "\\x20\\x09-\\x0D"
#: A boilerplate line has at most so many words; longer ones only mention the phrase.
BOILERPLATE_WORDS = 25
#: A navigation line has at least this many marks, and one for every so many words.
NAV_LEAST, NAV_EVERY = 2, 3
#: A line fails by punctuation if a symbol ends more than one in so many of its words, or if it has at least
#: this many words and no punctuation at all.
SYMBOL_EVERY, BARE_WORDS = 4, 12
#: A document is rejected when it loses more than this share of its characters, in per cent.
MAX_LOST = 50


def _words(text: Column) -> Column:
    """Words as an array; none for an empty text."""
    trimmed = F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))


def line_fails(line: Column) -> Column:
    """Why a line is removed: 'navigation', 'boilerplate' or 'punctuation'; null if it stays."""
    n = F.regexp_count(line, F.lit(f"[^{SPACES}]+"))
    nav = F.regexp_count(line, F.lit(f"(?<![^{SPACES}]){NAV_MARKS}+(?![^{SPACES}])"))
    symbols = F.regexp_count(line, F.lit(f"[#*$%&|<>](?![^{SPACES}])"))
    phrase = F.lower(line).rlike("|".join(BOILERPLATE))
    return (
        F.when((nav >= NAV_LEAST) & (nav * NAV_EVERY >= n), "navigation")
        .when(phrase & (n <= BOILERPLATE_WORDS), "boilerplate")
        .when((symbols * SYMBOL_EVERY > n) | ((n >= BARE_WORDS) & ~line.rlike(r"[.,;:!?…。，！？]")), "punctuation")
    )


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from words: positions inside 5-word windows that occur twice or more."""
    df = df.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get(F.col("__h"), i + k)
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))
    df = df.withColumn("__w", F.when(F.col("n_words") >= 6, windows))  # two equal windows may overlap
    # Most texts repeat nothing, which a set of longs tells; only the others sort their windows.
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__w")) < F.size("__w"), F.array_sort(F.transform("__w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.get(F.col("__s"), k)["h"] == x["h"]
    twice = lambda x, k: F.coalesce(F.when(k > 0, same(x, k - 1)), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))
    df = df.withColumn("__p", F.array_sort(F.transform(F.filter("__s", twice), lambda x: x["i"])))
    steps = F.transform("__p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get(F.col("__p"), k + 1) - p, F.lit(5))))
    n = F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)
    return df.withColumn("n_repeat_words", F.coalesce(n, F.lit(0)).cast("long")).drop("__h", "__w", "__s", "__p")


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base measures, cleaned_text (lines that stay), lost_chars, base_failed and kept.

    A null or empty text has no words and fails the base rules. Blank lines are neither judged nor lost.
    Repeated rows are judged alike; columns of df are kept, whatever they are called, unless they have the names
    given here.
    """
    cols = df.columns
    x = packed(df).withColumn("__t", F.coalesce(F.col("__r").getField(text), F.lit("")))
    x = x.withColumn("__words", _words(F.col("__t"))).withColumn("n_words", F.size("__words").cast("long"))
    x = _repeat_words(x).drop("__words")
    x = x.withColumn("word_chars", F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long"))
    x = x.withColumn("n_symbols", F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"))
    x = x.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda s: s.rlike(f"[^{SPACES}]")))
    x = x.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    x = x.withColumn("__kept", F.filter("__lines", lambda s: line_fails(s).isNull()))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + F.length(s))
    x = x.withColumn("__all", chars("__lines")).withColumn("lost_chars", (F.col("__all") - chars("__kept")).cast("long"))
    x = x.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    x = x.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.col("__all")))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "cleaned_text"]
    return unpacked(x.withColumn("cleaned_text", F.array_join("__kept", "\n")), cols, new)


def removed_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, reason) of every line that the rules remove."""
    x = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    return x.withColumn("reason", line_fails(F.col("line"))).where(F.col("reason").isNotNull() & F.col("line").rlike(f"[^{SPACES}]"))
