"""Titles that are nearly equal, in tiers, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import saved

#: Marks that sites put around or beside titles, and the brackets of them; least characters of a title
#: that another holds, and of titles compared by edits; most edits.
MARKS = ("完结", "全本", "完本", "全集", "精品", "推荐", "热门", "连载", "新书", "免费", "首发", "独家", "番外", "无删减", "已完结", "txt", "TXT")
OPEN, CLOSE = r"[\[【《〈「(]", r"[\]】》〉」)]"
LEAST_HELD, LEAST_EDITED, MOST_EDITS = 4, 4, 2
_PIECES = MOST_EDITS + 1


def title_body(c: Column) -> Column:
    """A title without marks, notes in brackets and what follows a colon; where only brackets would be left, what
    stands in them."""
    bare = lambda s: F.regexp_replace(s, r"[\[\]【】《》〈〉「」()]", "")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[（(][^（()）]*[）)]", ""), "[:：].*$", ""), r"[·\s]", "")
    short = F.regexp_replace(short, OPEN + "(?:" + "|".join(MARKS) + ")" + CLOSE, "")
    return F.when(bare(short) != "", short).otherwise(bare(c))


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - LEAST_HELD + 1), lambda i: F.substring(c, i, F.lit(LEAST_HELD))))


def _piece(n: Column, i: int) -> tuple[Column, Column]:
    """Place, from 1, and length of the i-th of three pieces of n characters."""
    cut = lambda k: F.floor(n * k / _PIECES).cast("int")
    return cut(i) + 1, cut(i + 1) - cut(i)


def _meet(a: DataFrame, b: DataFrame, left: Column, right: Column) -> DataFrame:
    """(a, b) that share one of their keys."""
    x = a.select("a", F.explode(left).alias("k")).join(b.select("b", F.explode(right).alias("k")), "k")
    return x.select("a", "b").distinct()


def near_titles(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, tier) of distinct titles `a` of wanted and `b` of found, each a table of one column of normal titles.

    0: equal; 1: equal bodies; 2: one holds the other, of at least four characters; 3: at most two edits between
    titles of at least four. The best tier counts. Null and empty titles meet nothing.

    Candidates are exact, none is missed: a title that is held shows its first four characters among the other's
    runs of four; of three pieces of a title two edits leave one whole, at most two places off.
    """
    # Written, as each tier reads both: else the tables that titles are made of are read once a tier.
    a = saved(wanted.toDF("a").where("a <> ''").distinct(), "wanted")
    b = saved(found.toDF("b").where("b <> ''").distinct(), "found")
    equal = a.join(b, F.col("a") == F.col("b")).select("a", "b")
    body = lambda t, c: t.withColumn("k", title_body(F.col(c))).where("k <> ''")
    bodies = body(a, "a").join(body(b, "b"), "k").select("a", "b")
    long_a, long_b = a.where(F.char_length("a") >= LEAST_HELD), b.where(F.char_length("b") >= LEAST_HELD)
    head = lambda c: F.array(F.substring(c, 1, LEAST_HELD))
    held = _meet(long_a, long_b, head("a"), _grams(F.col("b"))).where(F.contains("b", F.col("a"))).union(_meet(long_a, long_b, _grams(F.col("a")), head("b")).where(F.contains("a", F.col("b"))))
    n = F.char_length("a")
    whole = lambda i: F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring("a", *_piece(n, i)).alias("s"))
    edit_a = a.where(n >= LEAST_EDITED).select("a", F.explode(F.array(*map(whole, range(_PIECES)))).alias("k"))
    # b shows, for each length that a title within two edits can have, what stands where its pieces may be.
    m = F.char_length("b")
    sizes = F.sequence(F.greatest(F.lit(LEAST_EDITED), m - MOST_EDITS), m + MOST_EDITS)
    shown = b.where(m >= LEAST_EDITED).select("b", F.explode(sizes).alias("n"))

    def part(i, off):
        at, size = _piece(F.col("n"), i)
        return F.when((at + off >= 1) & (at + off + size - 1 <= m), F.struct(F.col("n"), F.lit(i).alias("i"), F.substring("b", at + off, size).alias("s")))

    keys = F.array_distinct(F.array_compact(F.array(*[part(i, off) for i in range(_PIECES) for off in range(-MOST_EDITS, MOST_EDITS + 1)])))
    edit_b = shown.select("b", F.explode(keys).alias("k"))
    edited = edit_a.join(edit_b, "k").select("a", "b").distinct().where(F.levenshtein("a", "b", MOST_EDITS) >= 0)
    tiers = [x.select("a", "b", F.lit(t).alias("tier")) for t, x in enumerate((equal, bodies, held, edited))]
    out = tiers[0]
    for x in tiers[1:]:
        out = out.union(x)
    return out.groupBy("a", "b").agg(F.min("tier").alias("tier"))


def author_bridge(tasks: DataFrame, titles: DataFrame, pool: DataFrame) -> DataFrame:
    """(task, url) of tasks (task, title, author) without a hit among titles (title), found by their author instead.

    pool is (url, author); urls that repeat count once. A task is bridged if exactly one url has its author. Unknown
    authors, null or empty after their key, and authors that are the title bridge nothing.
    """
    key = lambda c: X.loose_key(F.col(c))
    left = tasks.join(titles.select("title").distinct(), "title", "left_anti").withColumn("k", key("author"))
    left = left.where((F.col("k") != "") & (F.col("k") != key("title")))
    one = pool.where("url is not null").select("url", key("author").alias("k")).where("k <> ''").distinct()
    one = one.groupBy("k").agg(F.count("*").alias("urls"), F.min("url").alias("url")).where("urls = 1")
    return left.join(one, "k").select("task", "url")
