"""Names, chapter keys, urls, candidates, near titles and plans against tables of cases and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tomeflow.functions import names as N
from tomeflow.functions import urls as U
from tomeflow.operators import backfill, matching


def column(spark, values, use, kind="string"):
    """use(c) of each value, in order; a column beside it has a clashing name."""
    x = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], f"id int, c {kind}, text string")
    return [r.out for r in x.select("id", use(F.col("c")).alias("out")).orderBy("id").collect()]


def check(spark, cases, use):
    got = column(spark, list(cases), use)
    assert dict(zip(cases, got, strict=True)) == cases


def test_numbers(spark):
    check(spark, {"十": 10, "十二": 12, "二十三": 23, "一百零五": 105, "两千": 2000, "一千五": 1005, "三万": 30000, "万": 10000, "十万零三": 100003, "二十万": 200000, "〇": 0, "12": 12, "007": 7, "1百": None, "X": None, "": None, None: None, "一二": 2}, N.number_of)


def test_nfkc_and_verify_keys(spark):
    check(spark, {"Ａ１": "A1", "①": "1", "plain": "plain", "ﬁ": "fi", "": "", None: None}, N.nfkc)
    check(spark, {"《三体》：死神 永生!": "三体死神永生", "Ｄune_2": "dune2", "·": "", None: None}, N.verify_key)
    x = spark.createDataFrame([("刘慈欣", "慈欣"), ("", "a"), ("a", ""), (None, "a"), ("a", None), ("b", "a"), ("a", "ab")], "f string, w string")
    assert [r[0] for r in x.select(N.author_fits(F.col("f"), F.col("w"))).collect()] == [True, False, True, False, True, False, True]


def test_chapter_keys_and_tiers(spark):
    keys = {"第一章": ("第1章", 1, ""), "第 1 章": ("第1章", 1, ""), "《第十二回 Ａb！》": ("第12回ab", 12, "ab"), "第1章 风起...": ("第1章风起", 1, "风起"), "楔子。": ("楔子", None, "楔子"), "第章": ("第章", None, "第章"), "": ("", None, "")}
    got = column(spark, [*keys, None], lambda c: N.chapter_key(N.title_normal(c)))
    assert [tuple(r) for r in got[:-1]] == list(keys.values()) and (got[-1] is None or got[-1].key is None)
    tiers = [("第一章", "第1章", 0), ("第1章 风起", "第1回 风起", 1), ("第1章", "第一章 风起", 2), ("第1章 风起", "第一章 风起了", 3), ("第一章", "第三章", None), ("第1章 风起云", "前第1章风起云涌", 4), ("风起云涌", "风起云涌时", None), ("风起云涌时", "风起云涌时了", 4), ("甲", "乙", None), ("第1章 风", "第1章 风云", None)]
    x = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(tiers)], "id int, a string, b string")
    key = lambda c: N.chapter_key(N.title_normal(F.col(c)))
    got = x.select("id", key("a").alias("a"), key("b").alias("b")).select("id", N.chapter_tier(F.col("a"), F.col("b")).alias("t")).orderBy("id").collect()
    assert [(a, b, r.t) for (a, b, _), r in zip(tiers, got, strict=True)] == tiers


def test_chapter_titles(spark):
    check(spark, {
        "第2章 道生（求收藏！）": "第2章 道生", "第91章 杀破狼（求月票）APP免费": "第91章 杀破狼", "第9章 花（为盟主加更）": "第9章 花", "第3章 风 更新时间：2012-12-21 10:00": "第3章 风", "第3章 风-2012.12.21": "第3章 风",
        "第100章 2012.12.21": "第100章 2012.12.21", "第1章 风 2012.12.21": "第1章 风", "（求而不得）": "（求而不得）", "": "", None: None,
    }, N.chapter_title)
    check(spark, {"上架感言": True, "第八十章 上台感言": False, "关于更新": True, "风起": False, "": False}, N.is_notice)


def test_search_authors(spark):
    check(spark, {
        "张三 著": "张三", "南派三叔编著": "南派三叔", "[英] J.R.R.托尔金 著": "J.R.R.托尔金", "（日）东野圭吾，译者": "东野圭吾", "鸿蒙宏图": "鸿蒙宏图", "宏图": "宏图", "泰德图, 李四": "泰德", "著": "著", "  ": "", ",a": ",a", "": "", None: None, "王五等著": "王五", "李 编": "李",
    }, N.search_author)


def test_file_names(spark):
    x = spark.createDataFrame([(0, 'a/b:c*"', " d "), (1, None, ""), (2, "x　\n y--", "z -"), (3, "é" * 100, "a"), (4, "a" * 79 + "- b", "c")], "id int, t string, a string")
    got = [r[0] for r in x.orderBy("id").select(N.file_name(F.col("t"), F.col("a"))).collect()]
    assert got == ["abc-d.txt", "未命名-佚名.txt", "x y---z.txt", "é" * 80 + ".txt", "a" * 79 + ".txt"]


def test_notes(spark):
    known = ["太长", "太短"]
    x = spark.createDataFrame([(0, ["太短", "太长", "other"], " a\nb "), (1, [], "x"), (2, ["太短"], None), (3, [], "")], "id int, r array<string>, t string")
    assert [r[0] for r in x.orderBy("id").select(N.note(F.col("r"), F.col("t"), known)).collect()] == ["太长；太短\na\nb", "x", "太短", ""]
    got = column(spark, ["太长；太短\na\r\nb", "太长；x\ny", "太短", "太短；太短", "", None, "a\n太短"], lambda c: N.read_note(c, known))
    assert [r and (r.reasons, r.text) for r in got] == [(["太长", "太短"], "a\nb"), ([], "太长；x\ny"), (["太短"], ""), (["太短"], ""), ([], ""), None, ([], "a\n太短")]


def test_scores_and_candidates(spark):
    check(spark, {"12": 12, " 99.5 ": 100, "+.5": 1, "-3": 0, "1e3": None, "": None, None: None, "120": 100, "NaN": None, "49.4": 49}, N.score)
    one = lambda t, a, c="c", w="w", y="y": (t, a, c, w, y)
    lists = [
        [one(" T ", "a"), one("t", "A"), one("《t》", "a"), one("u", "a"), one("", "a"), one("v", None), one("w", "b\x00"), None, one("x" * 300, "a", None)],
        [one(str(i), "a") for i in range(20)],
        [],
        None,
    ]
    x = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "id int, c array<struct<title string, author string, category string, word_count string, why string>>")
    got = [r.c for r in x.select("id", N.clean_candidates(F.col("c")).alias("c")).orderBy("id").collect()]
    assert [(c.title, c.author, c.category) for c in got[0]] == [("T", "a", "c"), ("u", "a", "c"), ("x" * 200, "a", "")]
    assert [c.title for c in got[1]] == [str(i) for i in range(12)] and got[2:] == [[], []]


BASE = "https://Ex.com:443/a/b/c?q=1#f"
ABSOLUTE = {
    "d": "https://ex.com/a/b/d", "./d/../e": "https://ex.com/a/b/e", "../../../x": "https://ex.com/x", "..": "https://ex.com/a/", ".": "https://ex.com/a/b/", "/": "https://ex.com/", "/y?z#w": "https://ex.com/y?z#w",
    "?k=v": "https://ex.com/a/b/c?k=v", "#g": "https://ex.com/a/b/c?q=1#g", "//h.org": "https://h.org/", "http://h.org:80/%7e x": "http://h.org/%7e%20x", "HTTP:\\\\H.org\\p": "http://h.org/p", "https:d": "https://ex.com/a/b/d",
    "http:d": "http://d/", " \t/第?第#第 ": "https://ex.com/%E7%AC%AC?%E7%AC%AC#%E7%AC%AC", "/a'b?c'd": "https://ex.com/a'b?c%27d", "mailto:A@b": "mailto:A@b", "javascript:x": "javascript:x", "https://0x7f.1/": "https://127.0.0.1/",
    "https://münchen.de": "https://xn--mnchen-3ya.de/", "/%2e%2E/z": "https://ex.com/z", "https://u:p@h.org/": "https://u:p@h.org/", "https://h.org:8080": "https://h.org:8080/", "a//b": "https://ex.com/a/b/a//b", "https://[::1]/": "https://[::1]/",
    "": None, "  ": None, "https://": None, "https://a b/": None, "https://h:99999/": None, "https://1.2.3.4.5/": None, "https://256.1.1.1/": None, "https://h:x/": None,
}


@pytest.mark.parametrize("value", ABSOLUTE)
def test_absolute_urls(value):
    assert U.absolute(value, BASE) == ABSOLUTE[value]


def test_url_columns(spark):
    x = spark.createDataFrame([(0, "x", "http://h/"), (1, "x", None), (2, None, "http://h/"), (3, "http://a", None), (4, "x", "mailto:a"), (5, "x", "bad")], "id int, v string, b string")
    assert [r[0] for r in x.orderBy("id").select(U.absolute_url("v", "b")).collect()] == ["http://h/x", None, None, "http://a/", None, None]
    cases = [("a b*第", "utf-8", False, "a%20b*%E7%AC%AC"), ("a b*第~", "gbk", True, "a+b*%B5%DA%7E"), ("ç😀", "gbk", False, "%C3%A7%F0%9F%98%80"), ("(!)", "gb18030", False, "(!)"), ("(!)", "gb18030", True, "%28%21%29")]
    x = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate([*cases, (None, "gbk", False, None)])], "id int, s string, c string, f boolean")
    assert [r[0] for r in x.orderBy("id").select(U.query_text("s", "c", "f")).collect()] == [c[3] for c in cases] + [None]


def test_refusals(spark):
    cases = {
        "https://a.com/x": None, "https://a.com:443/": None, "HTTPS://A.com": None, "http://a.com": "scheme", "ftp://a.com": "scheme", "/x": "scheme", "https://u@a.com": "authority", "https://@a.com": "authority", "https:///x": "authority",
        "https://a.com:80/": "authority", "https://127.0.0.1": "address", "https://2130706433/": "address", "https://0x7f.1/": "address", "https://[::1]/": "address", "https://b.com/": "host", "https://a.com/ x": "characters", "https://a.com\\x": "characters",
        "": "characters", None: "characters", "https://a.com/" + "x" * 2048: "characters",
    }
    check(spark, cases, lambda c: U.refusal(c, ["a.com"]))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_titles(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("ab第风", k=rng.randint(1, 9)))
    a, b = ([word() for _ in range(120)] for _ in range(2))
    a += ["《全集》", "余生：上", "余生(全本)", "", None, a[0]]
    b += ["【全集】", "余生", "[全本]余生", "【】", "", None, "第" * 40]
    body = spark.createDataFrame([(x,) for x in {*a, *b} if x], "t string").select("t", matching.title_body(F.col("t")).alias("b")).collect()
    body = {r.t: r.b for r in body}
    assert (body["《全集》"], body["余生：上"], body["[全本]余生"], body["余生(全本)"], body["【】"]) == ("全集", "余生", "余生", "余生", "")
    want = {}
    for x in {*a} - {"", None}:
        for y in {*b} - {"", None}:
            least = min(len(x), len(y))
            if x == y:
                want[x, y] = 0
            elif body[x] == body[y] != "":
                want[x, y] = 1
            elif least >= 4 and (x in y or y in x):
                want[x, y] = 2
            elif least >= 4 and edits(x, y) <= 2:
                want[x, y] = 3
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "t string")
    got = matching.near_titles(frame(a), frame(b)).collect()
    assert {(r.a, r.b): r.tier for r in got} == want and len(got) == len(want) and {0, 1, 2, 3} == set(want.values())
    assert matching.near_titles(frame([]), frame(b)).count() == 0


def test_author_bridge(spark):
    tasks = spark.createDataFrame([(1, "t", "A·b"), (2, "seen", "a b"), (3, "u", "c"), (4, "ab", "ab"), (5, "v", None), (6, "w", "-"), (None, "t2", "ab")], "task int, title string, author string")
    pool = spark.createDataFrame([("u1", "ab"), ("u1", "A b"), ("u2", "c"), ("u3", "C"), (None, "ab"), ("u4", None), ("u5", "-")], "url string, author string")
    got = matching.author_bridge(tasks, spark.createDataFrame([("seen",), (None,)], "title string"), pool).collect()
    assert sorted((r.task or 0, r.url) for r in got) == [(0, "u1"), (1, "u1")]


def test_backfill_plan(spark):
    ids = lambda v: spark.createDataFrame([(x, "x") for x in v], "id long, reason string")
    got = backfill.plan(ids([5, 3, 9, 1, 3, None, 7]), ids([3, None]), ids([3, 9]), " p ", " r", most=2).collect()
    assert sorted(tuple(r) for r in got if r.reason is None) == [(1, None, "1:p:r"), (5, None, "5:p:r")]
    assert sorted(tuple(r) for r in got if r.reason) == [(3, "task", None), (9, "artifact", None)]
    with pytest.raises(ValueError, match="policy"):
        backfill.plan(ids([1]), ids([]), ids([]), " ")
