"""Bytes, charsets, volumes, lenient JSON, phrase tables and aligned contents against plain versions of their rules."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import lenientjson as L
from tomeflow.operators import phrases, tocalign
from tomeflow.sources import charset as C
from tomeflow.sources import volumes as V

ACCEPTED = {
    '{"a":1}': '{"a":1}', "{a:'x',b=>TRUE;c=nUll}": '{"a":"x","b":true,"c":null}', "[1,,2,]": "[1,null,2,null]", "[,]": "[null,null]", "[1;2]": "[1,2]",
    " # c\n)]}'\n{a:/* x */ 012}// d": '{"a":"012"}', r"'\u00e9\/\''": '"é/\'"', r"'\ud83d\ude00'": '"😀"', r"'\uD83D'": r'"\ud83d"', 'a"b': r'"a\"b"',
    "{true:-1.5e+3,a:1,a:2}": '{"true":-1.5e+3,"a":2}', "[[[]],{}]": "[[[]],{}]", "'a\nb'": r'"a\nb"', "{'':''}": '{"":""}', "NaN": '"NaN"', "[" * 255 + "]" * 255: "[" * 255 + "]" * 255,
}
REFUSED = ["", " ", "# c", "{a:1,}", "{a}", "{a:}", "{a", "[", "]", "[}", "{]", "[1 2]", "a b", "{a:1}}", "{;}", "[:]", "'", "'\\q'", "'\\u12'", "/* x", "\f1", "{a==1}", "{a:1 b:2}", "1,2", "[" * 256 + "]" * 256]


@pytest.mark.parametrize("text", ACCEPTED)
def test_lenient_json_accepts(text):
    assert L.plain_json(L.read(text)) == ACCEPTED[text]


@pytest.mark.parametrize("text", REFUSED)
def test_lenient_json_refuses(text):
    with pytest.raises(L.Refused):
        L.read(text)


def test_lenient_json_columns(spark):
    rows = [("{a:[1,{b:'x'}],c:{},d:[]}",), ("{a:null}",), ("1.0",), (None,), ("{",), ("'\u2028'",), ("9007199254740992",), ("-7",)]
    got = spark.createDataFrame(rows, "t string").select(L.to_json("t").alias("j"), L.to_pretty("t").alias("p")).collect()
    assert [r.j for r in got] == ['{"a":[1,{"b":"x"}],"c":{},"d":[]}', '{"a":null}', "1.0", None, None, '"\u2028"', "9007199254740992", "-7"]
    assert [r.p for r in got] == ['{\n  "a": [\n    1,\n    {\n      "b": "x"\n    }\n  ],\n  "c": {},\n  "d": []\n}', None, None, None, None, None, None, "-7"]


def test_charsets(spark):
    gb = lambda s: s.encode("gb18030")
    page = lambda meta, rest="第一章ç": f"<html><head>{meta}</head><body>{rest}"
    cases = [
        (page("<meta charset=gbk>").encode(), None, "utf-8", True),
        (gb(page('<meta name="x" content="charset=utf-8"><meta charset="GB2312">')), None, "gbk", True),
        (gb("第一章"), 'text/html; charset="GBK"', "gbk", True),
        (gb(page('<meta http-equiv="content-type" content="text/html; charset=gb18030">')), "text/html; charset=latin1", "gb18030", True),
        (gb(page("<!-- <meta charset=gbk> -->")), None, "utf-8", False),
        (gb(page("<script>'<meta charset=gbk>'</script>")), None, "utf-8", False),
        (gb(page("", "<meta charset=gbk>第")), None, "utf-8", False),
        (gb(page("<title>" + "x" * 1024 + "</title><meta charset=gbk>")), None, "utf-8", False),
        (b"\xff\xfe", "charset=gbk", "gbk", False),
        (b"", None, "utf-8", True),
        (None, None, None, None),
    ]
    rows = [(i, b, c) for i, (b, c, _, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, "id int, b binary, c string").select("id", C.decoded(F.col("b"), F.col("c")).alias("d")).orderBy("id").collect()
    for r, (raw, _, name, exact) in zip(got, cases, strict=True):
        assert (r.d.charset, r.d.exact) == (name, exact), raw
        if exact:
            assert r.d.text == raw.decode("gb18030" if name != "utf-8" else name)
    x = spark.createDataFrame([("第ç",), (None,)], "t string")
    assert [r[0] if r[0] is None else bytes(r[0]) for r in x.select(C.encoded("t", F.lit("gbk"))).collect()] == ["第".encode("gbk") + "ç".encode(), None]


def test_bodies(spark):
    wrap = lambda b: C.BASE64_PREFIX + base64.b64encode(b).decode()
    cases = [
        ('{"a":1}', None, "json", '{"a":1}'), ("\ufeff [1]", None, "json", "\ufeff [1]"), ("{a", None, "html", "{a"), ("3", "Application/JSON", "json", "3"), ("<p>", "text/json", "html", "<p>"),
        (wrap('{"a":"é"}'.encode()), None, "json", '{"a":"é"}'), (wrap(b"x" * 500), None, "html", "x" * 500), (wrap(b"\xff"), None, "html", "/w=="), (C.BASE64_PREFIX + "YR==", None, "html", "YR=="),
        (C.BASE64_PREFIX + "Y Q\n", None, "html", "a"), (C.BASE64_PREFIX + "!", None, "html", "!"), (C.BASE64_PREFIX, None, "html", ""), ("", None, "html", ""), (None, None, "html", ""),
    ]
    x = spark.createDataFrame([(i, t, c) for i, (t, c, _, _) in enumerate(cases)], "id int, t string, c string")
    got = x.select("id", C.body(F.col("t"), F.col("c")).alias("b")).orderBy("id").collect()
    assert [(r.b.kind, r.b.text) for r in got] == [(k, t) for _, _, k, t in cases]


def test_misread_texts_are_mended(spark):
    good = "他说这的心里都是好的，她也是这样想的好"
    bad = good.encode().decode("gbk", "ignore")
    rows = [(1, good, "x"), (2, bad, "x"), (3, f"{bad}\n{good}", "x"), (4, None, "x"), (5, "", "x"), (6, "plain", "x"), (7, f"{bad}\n\n{bad}\r\n{bad}", "x"), (8, "鍥鍦鎯鎴", "x")]
    got = {r.id: r.out for r in C.with_mended(spark.createDataFrame(rows, "id int, t string, out string"), "t", "out").collect()}
    again = bad.encode("gbk", "ignore").decode("utf-8", "ignore")
    assert got[2] == again and len(set(good) & set(again)) > len(set(good)) // 2
    assert [got[i] for i in (1, 3, 4, 5, 6)] == [r[1] for r in rows if r[0] in (1, 3, 4, 5, 6)]
    assert got[7].replace("\r", "").split("\n") == [again, "", again, again] and got[8] is None


TITLES = {
    "第1章": "第1章", "  第 十二 回　开始  ": "第 十二 回　开始", "正文 第三卷：风": "正文 第三卷：风", "【第一章讲的是。】": "【第一章讲的是。】", "Chapter 12 - dawn": "Chapter 12 - dawn", "chapter IV": "chapter IV",
    "序": "序", "序章、一": "序章、一", "番外三 花": "番外三 花", "\ufeff楔子": "\ufeff楔子".strip("\ufeff"), "第一章 " + "x" * 76: "第一章 " + "x" * 76,
    "第一章讲的是": None, "第一章 他走。": None, "第一章 a;b": None, "第一章 end.": None, "第一章 :": None, "Chapter 1234567890": None, "chapter": None, "他说第一章": None, "【abc】": None, "第一章 " + "x" * 77: None, "": None, "  ": None,
    "第一章 " + " " * 320: None,
}


@pytest.mark.parametrize("line", TITLES)
def test_titles(line):
    assert V.title_of(line) == TITLES[line]


def plain_chapters(text):
    """By lines, each with its end."""
    lines, line = [], ""
    for i, c in enumerate(text):
        line += c
        if c == "\n" or c == "\r" and text[i + 1 : i + 2] != "\n":
            lines.append(line)
            line = ""
    lines.append(line)
    if not text.strip(" \t\r\n\u3000\ufeff"):
        return []
    out, at, seen = [], 0, False
    for x in lines:
        title = V.title_of(x.rstrip("\r\n"))
        if title is not None:
            if not out and seen:
                out.append(("前言", 0))
            out.append((title, at if out else 0))
        seen = seen or bool(x.strip(" \t\r\n\u3000\ufeff"))
        at += len(x.encode())
    return out or [("正文", 0)]


def test_chapters_and_volumes_of_random_texts():
    rng = random.Random(4)
    pieces = ["\n", "\r\n", "\r", "第一章", "第二章 风", "chapter 3: x", "他说", "é", "plain words.", " ", "\u3000", "\ufeff", "😀", "序", "讲"]
    for _ in range(400):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 40)))
        data = text.encode()
        starts = V.chapter_starts(text)
        assert starts == plain_chapters(text)
        most = rng.randint(4, 30)
        ends = list(V.part_ends(data, 0, len(data), most))
        assert b"".join(data[a:e] for a, e in zip([0, *ends], ends)) == data and all(e - a <= most and data[a:e].decode() for a, e in zip([0, *ends], ends))
        soft = rng.randint(4, 60)
        hard = soft + rng.randint(4, 40)
        chapter_ends = [s for _, s in starts[1:]] + [len(data)] if starts else []
        vols = list(V.volume_ends(data, chapter_ends or [len(data)], soft, hard))
        assert (vols[-1] if vols else 0) == len(data) and vols == sorted(set(vols))
        for a, e in zip([0, *vols], vols):
            assert e - a <= hard and data[a:e].decode()
            inside = [x for x in chapter_ends if a < x < e]
            # A volume above the wished size holds one chapter's piece, perhaps with the end of nothing else.
            assert e - a <= soft or not inside or e - inside[-1] <= soft


def test_parts_keep_line_ends_together(spark):
    x = spark.createDataFrame([(b"ab\r\ncde\nfgh", 6), (b"abc\r\ndef", 4), ("ééé".encode(), 5), (b"", 4), (None, 4)], "b binary, n int")
    got = [[(p.first_byte, p.last_byte) for p in r[0]] for r in x.select(V.parts("b", "n")).collect()]
    assert got == [[(0, 4), (4, 8), (8, 11)], [(0, 3), (3, 7), (7, 8)], [(0, 4), (4, 6)], [], []]


def test_volumes_write_and_read_back(spark, tmp_path):
    rng = random.Random(2)
    line = lambda: "".join(rng.choices("abc éß第风😀", k=rng.randint(0, 60))) + rng.choice(["\n", "\r\n", "\r"])
    texts = {i: "".join(f"第{c}章 t\n" * rng.randint(0, 1) + line() * rng.randint(0, 8) for c in range(rng.randint(1, 12))) + "x" for i in range(30)}
    texts |= {100: "", 101: None, None: "no key", 102: " \n ", 103: "y" * 5000, 104: "x"}
    books = spark.createDataFrame([(k, t, "z") for k, t in texts.items()], "id long, text string, key string")
    path = str(tmp_path / "v")
    V.write(books, "id", "text", path, soft=300, hard=600, part=64)
    stored = V.manifests(spark.read.parquet(f"{path}/manifests")).cache()
    vols = spark.read.parquet(f"{path}/volumes")
    full = {k: t.encode() for k, t in texts.items() if k is not None and t}
    m = {r.key: r.manifest for r in stored.collect()}
    assert m.keys() == full.keys() and all(m[k] is not None and m[k].bytes == len(full[k]) and m[k].chars == len(texts[k]) for k in m)
    for k, x in m.items():
        assert [(c.t, c.s) for c in x.chapter_index] == V.chapter_starts(texts[k])
        assert all(b.bytes <= 600 for b in x.volumes)
    assert m[102].chapters == 0 and len(m[103].volumes) > 5
    wanted = [(k, *sorted(rng.sample(range(len(b) + 1), 2))) for k, b in full.items() for _ in range(6) if len(b) > 1] + [(k, 0, len(b)) for k, b in full.items()]
    odd = [(100, 0, 1), (999, 0, 1), (104, 0, 2), (104, -1, 1), (104, 1, 1), (None, 0, 1), (104, None, 1)]
    want = spark.createDataFrame(wanted + wanted[:3] + odd, "key long, first_byte long, last_byte long")
    got = {(r.key, r.first_byte, r.last_byte): r for r in V.read_ranges(want, stored, vols).collect()}
    assert len(got) == len(set(wanted + odd))
    for k, a, e in wanted:
        assert bytes(got[k, a, e].data) == full[k][a:e] and got[k, a, e].error is None
    assert [got[w].error for w in odd] == ["no manifest", "no manifest"] + ["no such range"] * 3 + ["no manifest", "no such range"] and all(got[w].data is None for w in odd)
    bad = vols.withColumn("data", F.when((F.col("key") == 103) & (F.col("volume") == 1), F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("data"))).where("not (key = 103 and volume = 2)")
    want = spark.createDataFrame([(103, 0, 600), (103, 0, 601), (103, 1200, 1300), (103, 1800, 1900)], "key long, first_byte long, last_byte long")
    assert {(r.first_byte, r.last_byte): r.error for r in V.read_ranges(want, stored, bad).collect()} == {(0, 600): None, (0, 601): "wrong bytes", (1200, 1300): "no volume", (1800, 1900): None}


def test_manifests_that_do_not_hold(spark):
    sha = "a" * 40
    vol = lambda a, e, n=None: f'{{"blob_sha":"{sha}","bytes":{e - a if n is None else n},"first_byte":{a},"last_byte":{e}}}'
    ch = lambda i, v, s, e, p=1: f'{{"i":{i},"t":"x","v":{v},"s":{s},"e":{e},"p":{p}}}'

    def man(vols, chs, size=10, chapters=None, version="aaaaaaaa", schema=2):
        return f'{{"schema":{schema},"format":"volumes","version":"{version}","blob_sha":"{sha}","bytes":{size},"chars":5,"chapters":{len(chs) if chapters is None else chapters},"volumes":[{",".join(vols)}],"chapter_index":[{",".join(chs)}]}}'

    two = [vol(0, 4), vol(4, 10)]
    cases = [
        (man(two, [ch(0, 0, 0, 5), ch(1, 1, 5, 10)]), True), (man(two, [ch(0, 0, 1, 3), ch(1, 1, 5, 6)]), True), (man([vol(0, 10)], []), True),
        (man(two, [], version="b"), False), (man(two, [], schema=1), False), (man([], []), False), (man([vol(0, 4), vol(5, 10)], []), False), (man([vol(1, 10)], []), False), (man([vol(0, 9)], []), False),
        (man([vol(0, 10, 9)], []), False), (man(two, [ch(1, 0, 0, 5)]), False), (man(two, [ch(0, 1, 0, 5)]), False), (man(two, [ch(0, 2, 0, 5)]), False), (man(two, [ch(0, 0, 0, 6), ch(1, 1, 5, 10)]), False),
        (man(two, [ch(0, 0, 3, 3)]), False), (man(two, [ch(0, 0, 0, 11)]), False), (man(two, [ch(0, 0, 0, 3, 0)]), False), (man(two, [], chapters=1), False), ("{", False), ("", False), (None, False),
    ]
    got = V.manifests(spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "id int, manifest string")).orderBy("id").collect()
    assert [r.manifest is not None for r in got] == [ok for _, ok in cases]


def test_bounded_files(spark, tmp_path):
    for name, data in (("a", b"abc"), ("b", b""), ("c", b"\xff"), ("d", b"x" * 11), ("e", "é".encode() * 5)):
        (tmp_path / name).write_bytes(data)
    got = {r.path[-1]: (r.text, r.error) for r in V.bounded_files(spark, str(tmp_path), 10).collect()}
    assert got == {"a": ("abc", None), "c": (None, "invalid-utf8"), "d": (None, "too-large"), "e": ("ééééé", None)}


def quadratic(text, table):
    out, i = "", 0
    while i < len(text):
        n = max((len(p) for p in table if text.startswith(p, i)), default=0)
        out += table[text[i : i + n]] if n else text[i]
        i += n or 1
    return out


@pytest.mark.parametrize("most", [1000, 0])
def test_phrases(spark, most):
    rng = random.Random(8)
    word = lambda a, b: "".join(rng.choices("ab]^é😀-\n", k=rng.randint(a, b)))
    table = {word(1, 5): word(0, 4) for _ in range(40)} | {"ab": "ab"}
    texts = [word(0, 60) for _ in range(60)] + ["", None]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(70, texts[0], "x")], "id long, text string, phrase string")
    pairs = spark.createDataFrame([*table.items(), ("ab", "zz"), ("", "e"), (None, "n"), ("a" * 9, None)], "phrase string, value string")
    got = {r.id: r.out for r in phrases.convert(rows, "id", "text", "out", pairs, "phrase", "value", most).collect()}
    assert got == {i: None if t is None else quadratic(t, table) for i, t in [*enumerate(texts), (70, texts[0])]}


def test_an_empty_phrase_table_changes_nothing(spark):
    rows = spark.createDataFrame([(1, "abc")], "id long, text string")
    none = spark.createDataFrame([], "phrase string, value string")
    assert phrases.convert(rows, "id", "text", "text", none, "phrase", "value").first().text == "abc"


def plain_alignment(plan, anchor, first, last):
    ours = plan[first:last]
    begin = next((k for k, n in enumerate(ours) if n), None)
    places = [k for k, n in enumerate(anchor) if begin is not None and n == ours[begin]]
    if not places:
        return None
    there = min(places, key=lambda k: (abs(k - first - begin), k)) - begin
    if there < 0:
        return None
    a, b = [n for n in ours if n], [n for n in anchor[there : there + len(ours)] if n]
    sa, sb = set(a), set(b)
    if min(len(sa), len(sb)) < 5 or min(sum(map(len, sa)), sum(map(len, sb))) < 10 or len(sa & sb) < 5 or round(len(sa & sb) / len(sa | sb), 6) < 0.6:
        return None
    x, y = a[:8], b[:8]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
    return there - first if round(table[-1][-1] / min(len(x), len(y)), 6) >= 0.6 else None


def test_alignment(spark):
    rng = random.Random(3)
    plans = {i: [None if rng.random() < 0.15 else f"name{rng.randint(0, 25)}" if rng.random() < 0.3 else f"title{i}x{k}" for k in range(30)] for i in range(12)}
    windows, contents, want = [], [], {}
    for i, names in plans.items():
        other = [*(f"extra{k}" for k in range(rng.randint(0, 4))), *names[rng.randint(0, 3) :]]
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice([[], [other[at]] * 2, [None], ["other"]])
        contents += [(k, no, n) for k, ns in ((i, names), (100 + i, other)) for no, n in enumerate(ns)]
        for first in (0, 3, 10, 20, 28, 40):
            w = (i, 100 + i, first, first + rng.choice([7, 12]))
            windows.append(w)
            if (off := plain_alignment(names, other, w[2], w[3])) is not None:
                want[w] = off
    windows += [windows[0], (1, 999, 0, 9), (999, 1, 0, 9), (None, 1, 0, 9), (1, None, 0, 9)]
    x = spark.createDataFrame(windows, "plan long, anchor long, first int, last int")
    got = tocalign.align(x, spark.createDataFrame(contents, "key long, no int, name string")).collect()
    assert {(r.plan, r.anchor, r["first"], r["last"]): r.offset for r in got} == want and len(got) == len(want) > 15 and len(set(want.values())) > 3


def test_chapter_pairs(spark):
    rows = [(1, 0, 5), (1, 1, 6), (2, 0, 6), (2, 1, 7), (3, 0, None), (3, 1, 6), (4, 0, 6), (4, 1, 6), (4, 2, 7)]
    pairs = [(1, 2), (1, 3), (2, 4), (1, 2), (1, 9), (None, 1)]
    got = tocalign.chapter_pairs(spark.createDataFrame(pairs, "a int, b int"), spark.createDataFrame(rows, "key int, place int, number int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, True, 1, 0), (1, 3, False, 0, 0), (1, 3, False, 1, 1), (2, 4, False, 0, 0), (2, 4, False, 1, 1)]
