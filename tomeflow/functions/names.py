"""Column functions on titles, authors, chapter names, notes and candidates; all but NFKC are built in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

#: Digits and their values, signs of units and theirs, signs of what a number counts.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
MYRIAD = "万"
COUNTED = "章节回卷篇部集"
#: What ends a chapter's name without being of it; least common part of names that hold each other.
TAIL = r"[.。、,;:!?·…~—\-]+$"
LEAST_REST, LEAST_KEY, LEAST_SHORT_KEY, ORDINAL = 2, 4, 5, 4
#: Punctuation that names are compared without; signs between authors; words for what an author did.
IGNORED = r"[\s·•《》「」『』【】()（）\[\]：:，,。.!！?？'\"“”‘’_-]"
BETWEEN_AUTHORS = "[,，、;；/]"
ROLES = ("著", "编", "主编", "编著", "编撰", "选编", "编译", "译", "译著", "校注", "校订", "校", "绘", "绘图", "图", "注", "点校", "整理")
NATION = r"^[（(【〔\[][一-龥A-Za-z]{1,4}[）)】〕\]]\s*"
#: Characters of a file name at most, and names for what is missing.
FILE_CHARS, NO_TITLE, NO_AUTHOR = 80, "未命名", "佚名"
#: Requests, thanks and times that sites put into chapter titles.
TITLE_NOISE = (
    r"\s*[（(]\s*(?:跪求|拜求|求)(?:收藏|推荐|月票|票|订阅|打赏|支持|点击|首订|全订)[^()（）]{0,10}[)）]",
    r"\s*[（(][^()（）]{0,12}(?:盟主|加更|[一二三四五六七八九十0-9]更)[^()（）]{0,6}[)）]",
    r"(?i)\s*APP\s*免费",
    r"\s*(?:(?:更新时间|更新于|更新)\s*[:：]?|[:：|｜\-—–])\s*\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?(?:\s*\d{1,2}:\d{2}(?::\d{2})?)?\s*$",
)
DATE_TAIL = r"\s*\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?(?:\s*\d{1,2}:\d{2}(?::\d{2})?)?\s*$"
NUMBERED = r"^\s*(?:正文\s*)?第[0-9一二三四五六七八九十百千万零〇两]+[章节卷回集话部篇]"
NO_BODY = r"感言|公告|上架|推荐一本|请假|通知|冲榜|加更|单章|书友|作品相关|人物列表|月末总结|新书|^\s*关于"


@F.pandas_udf(T.StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else unicodedata.normalize("NFKC", s) for s in c], dtype="object")


def nfkc(c: Column) -> Column:
    """Compatibility forms folded; plain ASCII goes past Python as nulls."""
    wide = c.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _nfkc(F.when(wide, c))).otherwise(c)


def number_of(c: Column) -> Column:
    """Value of a number in Arabic digits, or in Chinese ones with units up to ten thousand; null for anything else."""
    long = lambda n: F.lit(n).cast("long")
    values = F.create_map(*[F.lit(x) for k, v in (DIGITS | UNITS).items() for x in (k, v)])
    state = lambda total, part, digit, ok: F.struct(total.alias("total"), part.alias("part"), digit.alias("digit"), ok.alias("ok"))

    def step(s, ch):
        value = F.element_at(values, ch).cast("long")
        one = F.when(s["digit"] == 0, long(1)).otherwise(s["digit"])
        whole = F.when(s["part"] + s["digit"] == 0, long(1)).otherwise(s["part"] + s["digit"])
        unit, myriad = ch.isin(*UNITS), ch == MYRIAD
        return state(
            F.when(myriad, s["total"] + whole * 10_000).otherwise(s["total"]),
            F.when(myriad, long(0)).when(unit, s["part"] + one * value).otherwise(s["part"]),
            F.when(myriad | unit, long(0)).otherwise(F.coalesce(value, long(0))),
            s["ok"] & (myriad | value.isNotNull()),
        )

    chars = F.filter(F.split(c, ""), lambda x: x != "")
    read = F.aggregate(chars, state(long(0), long(0), long(0), F.lit(True)), step, lambda s: F.when(s["ok"], s["total"] + s["part"] + s["digit"]))
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long")).when(c != "", read)


def title_normal(c: Column) -> Column:
    """NFKC, without blanks and one pair of title brackets around all of it, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(X.btrim_blanks(nfkc(c)), "^《(.+)》$", "$1"), r"\s+", ""))


def chapter_key(normal: Column) -> Column:
    """struct(key, number, rest) of a title as title_normal gives it: its number in Arabic digits whatever it is
    written in, and the name behind it; without a number the name alone."""
    name = F.regexp_replace(normal, TAIL, "")
    mark = "^第([零〇一二三四五六七八九十百千万两0-9]+)([" + COUNTED + "])"

    # Each value is bound once: inside lambdas nothing is shared, and the number is dear.
    def read(s):
        return X.let(F.nullif(F.regexp_extract(s, mark, 1), F.lit("")), lambda digits: X.let(number_of(digits), lambda number: numbered(s, number)))

    def numbered(s, number):
        rest = F.when(number.isNotNull(), F.regexp_replace(F.regexp_replace(s, mark, ""), TAIL, "")).otherwise(s)
        whole = lambda rest: F.when(number.isNotNull(), F.concat(F.lit("第"), number.cast("string"), F.regexp_extract(s, mark, 2), rest)).otherwise(s)
        return X.let(rest, lambda rest: F.struct(whole(rest).alias("key"), number.alias("number"), rest.alias("rest")))

    return X.let(name, read)


def _holds(a: Column, b: Column, least) -> Column:
    return (F.least(F.char_length(a), F.char_length(b)) >= least) & (F.contains(a, b) | F.contains(b, a))


def chapter_tier(wanted: Column, found: Column) -> Column:
    """How well two chapter keys meet, 0 best: equal; number and name; number, and one has no name; number, and one
    name holds the other; one key holds the other by enough characters. Null if they don't."""
    numbered = F.coalesce(wanted["number"] == found["number"], F.lit(False))
    least = F.when(F.char_length(wanted["key"]) > ORDINAL, LEAST_KEY).otherwise(LEAST_SHORT_KEY)
    return (
        F.when(wanted["key"] == found["key"], 0)
        .when(numbered & (wanted["rest"] == found["rest"]), 1)
        .when(numbered & ((wanted["rest"] == "") | (found["rest"] == "")), 2)
        .when(numbered & _holds(wanted["rest"], found["rest"], LEAST_REST), 3)
        .when(_holds(wanted["key"], found["key"], least), 4)
    )


def chapter_title(c: Column) -> Column:
    """A chapter's title without what sites add. A date behind it goes only if a name besides the number is left."""
    for pattern in TITLE_NOISE:
        c = F.regexp_replace(c, pattern, "")

    def dated(s):
        rest = X.btrim_blanks(F.regexp_replace(s, DATE_TAIL, ""))
        return F.when(X.btrim_blanks(F.regexp_replace(rest, NUMBERED, "")) != "", rest).otherwise(s)

    return X.let(X.btrim_blanks(c), dated)


def is_notice(title: Column) -> Column:
    """Whether an entry of a table of contents is no chapter but a notice: without a number, and with a word of such."""
    return ~title.rlike(NUMBERED) & title.rlike(NO_BODY)


def verify_key(c: Column) -> Column:
    """NFKC, lower case, without punctuation: equal ones are one title."""
    return F.regexp_replace(F.lower(nfkc(c)), IGNORED, "")


def author_fits(found: Column, wanted: Column) -> Column:
    """Of two verify keys: one holds the other. An author that isn't known fits all, one that isn't found none."""
    return (F.coalesce(wanted, F.lit("")) == "") | (F.coalesce(found != "", F.lit(False)) & (F.contains(found, wanted) | F.contains(wanted, found)))


def search_author(c: Column) -> Column:
    """The first author's name alone: without nation and without what they did, where two characters are left.

    Words of one character at the end go only if several authors or a nation show that the name is a published one.
    """
    several = [r for r in ROLES if len(r) > 1]
    role = "(?:等)?(?:" + "|".join(sorted(ROLES, key=len, reverse=True)) + ")"
    clear = "(?:等)?(?:著|" + "|".join(several) + ")$"
    raw = X.btrim_blanks(c)

    def of_first(s):
        first = X.btrim_blanks(F.split(s, BETWEEN_AUTHORS)[0])
        joined = F.regexp_replace(F.regexp_replace(first, r"\s+", " "), f"(?:^| ){role}(?: {role})*$", "")
        name = X.btrim_blanks(F.regexp_replace(joined, NATION, ""))
        published = (first != s) | (name != joined)
        bare = X.btrim_blanks(F.when(published, F.regexp_replace(name, role + "$", "")).otherwise(F.regexp_replace(name, clear, "")))
        name = F.when(F.char_length(bare) >= 2, bare).otherwise(name)
        return F.when(first == "", s).otherwise(F.coalesce(F.nullif(name, F.lit("")), first))

    return X.let(raw, of_first)


def file_name(title: Column, author: Column) -> Column:
    """title-author.txt, without characters that file systems refuse; missing ones have a name that says so."""
    known = lambda c, other: F.coalesce(F.nullif(X.btrim_blanks(c), F.lit("")), F.lit(other))
    return F.concat(file_part(F.concat(known(title, NO_TITLE), F.lit("-"), known(author, NO_AUTHOR))), F.lit(".txt"))


def file_part(c: Column) -> Column:
    """A name without refused characters, blanks in a row, and hyphens or blanks at its end; at most so many characters."""
    plain = F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f\x7f]', ""), r"[\s\x{A0}\x{3000}\x{FEFF}]+", " ")
    end = lambda s: F.regexp_replace(s, r"[-\s]+$", "")
    return end(F.substring(end(X.btrim_blanks(plain)), 1, FILE_CHARS))


def note(reasons: Column, text: Column, known: list[str]) -> Column:
    """A note's one text: the known reasons in their order on the first line, then the free text."""
    chosen = F.array_join(F.filter(F.array(*map(F.lit, known)), lambda r: F.array_contains(reasons, r)), "；")
    return F.array_join(F.filter(F.array(chosen, X.btrim_blanks(F.coalesce(text, F.lit("")))), lambda s: s != ""), "\n")


def read_note(c: Column, known: list[str]) -> Column:
    """struct(reasons, text) of a note; a first line that isn't known reasons alone is text, like the rest."""
    first = F.split(F.regexp_replace(c, "(?s)\r?\n.*$", ""), "；")
    told = F.forall(first, lambda r: r.isin(*known))
    rest = F.regexp_replace(F.regexp_replace(c, "^[^\r\n]*\r?\n?", ""), "\r\n", "\n")
    return F.when(c.isNotNull(), F.struct(F.when(told, F.array_distinct(first)).otherwise(F.array().cast("array<string>")).alias("reasons"), F.when(told, rest).otherwise(c).alias("text")))


def storable(c: Column) -> Column:
    """Whether a database takes the text: no NUL. Halves of characters can't stand in Spark's strings."""
    return ~F.contains(c, F.lit("\x00"))


def score(c: Column, least: int = 0, most: int = 100) -> Column:
    """A decimal number in a text, rounded half up and kept within bounds; null for anything else, as 1e3 or blanks."""
    shaped = X.btrim_blanks(c).rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$")
    return F.when(shaped, F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), F.floor(X.btrim_blanks(c).try_cast("double") + 0.5).cast("double")))).cast("int")


def clean_candidates(c: Column, most: int = 12, name_chars: int = 200, chars: int = 500) -> Column:
    """Of the first candidates of an array of structs with title, author and further texts: those whose texts can all
    be stored and that have both names, trimmed and cut; of several with one identity the first. Null gives none."""
    fields = ("title", "author", "category", "word_count", "why")
    text = lambda x, f: F.substring(X.btrim_blanks(F.coalesce(x[f], F.lit(""))), 1, name_chars if f in ("title", "author") else chars)
    good = F.filter(F.slice(c, 1, most), lambda x: x.isNotNull() & F.forall(F.array(*[F.coalesce(x[f], F.lit("")) for f in fields]), storable))
    clean = F.filter(F.transform(good, lambda x: F.struct(*[text(x, f).alias(f) for f in fields])), lambda x: (x["title"] != "") & (x["author"] != ""))
    keyed = F.transform(clean, lambda x: F.struct(X.identity_title(x["title"]).alias("t"), X.identity_author(x["author"]).alias("a"), x.alias("x")))
    first = lambda k: F.filter(k, lambda x, i: ~F.exists(F.slice(k, F.lit(1), i), lambda y: (y["t"] == x["t"]) & (y["a"] == x["a"])))
    return F.transform(X.let(F.coalesce(keyed, F.array()), first), lambda x: x["x"])
