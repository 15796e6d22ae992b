"""Selectors, steps, XPath and the table function, on pages in which every form has something to find."""

import random

import pytest
from pyspark.sql import functions as F

from tomeflow.operators import extraction as E
from tomeflow.operators import jsonpath, markup, pagerules, xpath
from tomeflow.plans import pages as P

PAGE = """<html><body><div id="list" class="Box main"><dl><dt>Latest</dt><dd><a href="/c/9">nine</a></dd><dt>All</dt>
<dd><a href="/c/1" title="first">one</a></dd><dd><a href="/c/2">two</a></dd><dd>no link</dd></dl></div>
<ul class="x"><li>a<li class="sel" data-k="[1]">b <b>bold</b><li>c<li>d<li>e</ul>
<p>By: Zhang <i>San</i></p><span>s</span><a href="/read/1.html">Read all</a><a href="">empty</a>
<table><tr><td id="text"><p>p1</p><p>p2</p><p>p3</p><p>p4</p></td><td>7 items, 2.5 kg</td></tr></table></body></html>"""

SELECTORS = {
    "li, dt@text": ["Latest", "All", "a", "b bold", "c", "d", "e"], "LI.sel@text": ["b bold"], "li:not(.sel, :last-child)@text": ["a", "c", "d"],
    "li:eq(1)@text": ["b bold"], "li:lt(2)@text": ["a", "b bold"], "li:gt(2)@text": ["d", "e"], "li:nth-child(2n)@text": ["b bold", "d"], "li:nth-child(-n+2)@text": ["a", "b bold"],
    "li:nth-last-child(1)@text": ["e"], "li:nth-child(2n + 1)@text": ["a", "c", "e"], "dd:nth-of-type(2)@text": ["one"], "dl:has(> dt)@class": [], "div:has(> dl)@id": ["list"],
    "div:has(> dt)@id": [], "dt:has(+ dd)@text": ["Latest", "All"], "a[href~=[.]html]@text": ["Read all"], "a[^hre]@href": ["/c/9", "/c/1", "/c/2", "/read/1.html", ""],
    "a[title!=first][href^=/C/]@text": ["nine", "two"], "li[data-k='[1]']@ownText": ["b"], "i:only-child@text": ["San"], "dt:first-of-type@text": ["Latest"], ":root@id": [],
    "p:contains(zhang san)@ownText": ["By: Zhang"], "p:containsOwn(san)@text": [], "dd > a@text": ["nine", "one", "two"], "dt ~ dd@text": ["nine", "one", "two", "no link"],
}

STEPS = {
    "id.list@tag.dd@tag.a@href": ["/c/9", "/c/1", "/c/2"], "class.Box main@tag.dd.0@text": ["nine"], "tag.li.-1@text": ["e"], "tag.li.1:3@text": ["b bold", "c"], "tag.li.-2:9@text": ["d", "e"], "tag.li.-2:-1@text": ["d"],
    "tag.li!0:-1@text": ["b bold", "c", "d"], "tag.li[0,2]@text": ["a", "c"], "tag.li[-1,0]@text": ["e", "a"], "tag.li[1:3]@text": ["b bold", "c", "d"], "tag.li[3:1]@text": ["d", "c", "b bold"],
    "tag.li[0:4:2]@text": ["a", "c", "e"], "tag.li[!1,2]@text": ["a", "d", "e"], "tag.li[::-1]@text": ["a", "e"], "tag.li[9]@text": [], "tag.li.[0]@text": ["a"],
    "class.x@children.1@text": ["b bold"], "class.x@children[0,-1]@text": ["a", "e"], "text.Read@href": ["/read/1.html"], "text.Zhang@text": ["By: Zhang San"], "tag.dl@tag.dl@tag.dt@text": ["Latest", "All"],
    "ul tag.b@text": ["bold"], "tag.li.!0@text": ["b bold", "c", "d", "e"], "@css:ul.x > li.sel@data-k": ["[1]"], "tag.li@text!-2": ["d"], "id.none@tag.a@href": [],
}


@pytest.mark.parametrize("rule", [*SELECTORS, *STEPS])
def test_rules(rule):
    assert E.select(PAGE, rule) == (SELECTORS | STEPS)[rule]


@pytest.mark.parametrize("rule", ["li:matches(x)@text", "li[=x]@text", "li:nth-child(x)@text", "li >> a@text", "> @text", "li[@text", "li:not(@text", "tag.li[0:4:]@text", ",li@text", "//li[", "//li/foo()", "//bar::x", "//li[frob(1)]"])
def test_errors_show_when_rules_are_compiled(rule):
    with pytest.raises(ValueError):
        pagerules.Rule(rule)


XPATHS = {
    "//p[contains(text(), 'By:')]/text()": ["By: Zhang"], "//a[text()='Read all']/@href": ["/read/1.html"], "//span/following-sibling::a/@href": ["/read/1.html"], "//i/../text()": ["By: Zhang"],
    "//dd[a]/a/text()": ["nine", "one", "two"], "//*[@id='list']//dt[2]/following-sibling::dd": ["one", "two", "no link"], "//td[@id='text']/p[position() < last()-1]": ["p1", "p2"],
    "//td/p[last()]/text() | //dt[1]/text()": ["Latest", "p4"], "//ul/li[.//b]/@data-k": ["[1]"], "//li[not(@class)][2]": ["c"], "(//dd)[2]": ["one"], "//dd[1]/preceding-sibling::dt": ["Latest"],
    "//b/ancestor::li/@class": ["sel"], "//dl/descendant-or-self::dl/dt[1]": ["Latest"], "//dt[last()]/following-sibling-one::*": ["one"], "//dt[2]/preceding-sibling-one::dd": ["nine"],
    "count(//li)": ["5"], "string-length(//dt[1])": ["6"], "concat(//dt[1], '-', //dt[2])": ["Latest-All"], "substring-after(//a[@title]/@href, '/c/')": ["1"], "substring-before-last('a/b/c', '/')": ["a/b"],
    "substring('12345', 2, 3)": ["234"], "//li[position() mod 2 = 0]": ["b bold", "d"], "//li[starts-with(., 'b') or . = 'e']": ["b bold", "e"], "//a[@href ^= '/c/' and @href $= '2']": ["two"],
    "//a[@href ~= '[.]html$']": ["Read all"], "//a[@href *= 'read']/@href": ["/read/1.html"], "//td[2]/num()": ["7"], "//li[2]/allText()": ["b bold"], "//li[2]/html()": ["b <b>bold</b>"], "//b/outerHtml()": ["<b>bold</b>"],
    "//a[not(@href)]": ["empty"], "//li[3]/preceding::dt": ["Latest", "All"], "//table/preceding::li[1]": ["e"], "3 + 4 * 2 div 4 - 1": ["4"], "//td/p[. > 'p']": [], "//li[1]/self::li": ["a"], "//none/@x": [], "normalize-space('  a  b ')": ["a b"],
}


@pytest.mark.parametrize("path", XPATHS)
def test_xpath(path):
    assert xpath.values(xpath.compile_xpath(path), markup.parse(PAGE)) == XPATHS[path]


def naive(root, steps):
    """Elements that (axis, tag, place) steps find, by looking at every pair of nodes."""
    every = [n for n in root.tree if n.tag != markup.TEXT]
    kin = lambda n: n.parent.elements() if n.parent else [n]
    holds = {
        "child": lambda a, b: b.parent is a, "descendant": lambda a, b: a.order < b.order < a.end, "ancestor": lambda a, b: b.order < a.order < b.end and b.parent is not None, "self": lambda a, b: a is b,
        "following": lambda a, b: b.order >= a.end, "preceding": lambda a, b: b.end <= a.order and b.parent is not None, "following-sibling": lambda a, b: b in kin(a) and b.order > a.order,
        "preceding-sibling": lambda a, b: b in kin(a) and b.order < a.order, "parent": lambda a, b: a.parent is b,
    }
    now = [root]
    for axis, tag, place in steps:
        found = set()
        for a in now:
            fit = [b for b in every if holds[axis](a, b) and tag in ("*", b.tag) and b.tag]
            fit = fit[::-1] if axis in ("ancestor", "preceding", "preceding-sibling") else fit
            found |= set(fit if place is None else fit[place - 1 : place])
        now = sorted(found, key=lambda n: n.order)
    return now


def test_xpath_axes_against_pairs_of_nodes():
    rng = random.Random(8)
    axes = ["child", "descendant", "ancestor", "self", "following", "preceding", "following-sibling", "preceding-sibling", "parent"]
    for _ in range(150):
        html, open_ = "", []
        for _ in range(rng.randint(1, 25)):
            if open_ and rng.random() < 0.4:
                html += f"</{open_.pop()}>"
            else:
                open_.append(rng.choice("abi"))
                html += f"<{open_[-1]}>x"
        root = markup.parse(html)
        steps = [("descendant", rng.choice("abi*"), None)] + [(rng.choice(axes), rng.choice("abi**"), rng.choice([None, None, 1, 2])) for _ in range(rng.randint(1, 3))]
        path = "/" + "/".join(f"{a}::{t}" + (f"[{p}]" if p else "") for a, t, p in steps)
        assert xpath.nodes(xpath.compile_xpath(path), root) == naive(root, steps), (html, path)


def test_plain_paths_are_selectors():
    root = markup.parse(PAGE)
    paths = {"//ul/li": 5, "//ul/li[2]": 1, "//div//a[@href='/c/1']": 1, "//td/p[last()]": 1, "//a[contains(@href,'/c/')]": 3, "//a[@href]": 4, "//*[@id='list']/dl/dt": 2, "//ul/*[3]": 1}
    for p, n in paths.items():
        s = xpath.to_selector(p)
        got = markup.find(root, markup.compile_selector(s))
        assert got == xpath.nodes(xpath.compile_xpath(p), root) and len(got) == n, (p, s)
    assert [xpath.to_selector(p) for p in ("//a/text()", "//a/..", "//li[position()>1]", "//a | //b", "count(//a)", "//a[@x][2]", "a")] == [None] * 7


def test_deep_and_odd_pages(spark):
    deep = "<div>" * 5000 + "x"
    assert E.select(deep, "div:last-child div@text") and len(E.select(deep, "//div")) == 5000
    assert len(E.select(deep, "div@all!0")[0]) == 5000 * 11 + 1
    rows = [(1, deep), (2, None), (3, ""), (4, "<p>a" * 3), (5, "<a href=x>" * 3), (6, "[" * 100_000)]
    x = spark.createDataFrame(rows, "id int, h string")
    got = E.extract(x, "h", {"t": "p@text||div div div@class", "n": "//p[2]", "slow": "//div[count(//div) > 0]"}).orderBy("id").select("id", "t", "n", "slow").collect()
    assert [(r.id, r.t, r.n) for r in got] == [(1, None, None), (2, None, None), (3, None, None), (4, "a", "a"), (5, None, None), (6, None, None)]
    assert got[0].slow is None  # beyond the visit budget
    assert [r[0] for r in x.orderBy("id").select(jsonpath.find_all(F.col("h"), "$..a")).collect()] == [[]] * 6


def test_table_function(spark):
    x = spark.createDataFrame([(1, PAGE, "k"), (2, None, None), (3, "<ul><li>", "k")], "page_id int, html string, name string")
    fields = {"name": "b@text", "k": "@data-k", "letter": "text", "n": ["b@text", "bigint"]}
    got = [tuple(r) for r in pagerules.page_rows(x.select("page_id", "html"), "html", "ul li", fields).orderBy("page_id", "item_no").collect()]
    assert got[1] == (1, 1, "bold", "[1]", "b bold", None, "n")
    assert [r[:2] for r in got] == [(1, i) for i in range(5)] + [(3, 0)] and got[0] == (1, 0, None, None, "a", None, None)
    with pytest.raises(Exception, match="unsupported"):
        pagerules.page_rows(x.select("page_id", "html"), "html", "ul li", {"a": "b:frob(1)@text"}).collect()


def test_rules_are_split_outside_brackets(spark):
    x = spark.createDataFrame([('{"b": [{"t": "a||b", "p": 1}, {"t": "c&&d", "p": 2}]}',)], "j string")
    rule = "$.none||$.b[?(@.t == 'a||b' || @.t == 'c&&d')].p"
    assert x.select(E.compile_rule(rule, F.col("j"))).first()[0] == "1\n2"


def toc_of(pages, starts, most):
    """Pages followed one by one; pages: {(book, url): (chapters, next)}."""
    out = {}
    for book, url in starts:
        seen, last, at = set(), {}, 0
        while url is not None and (book, url) in pages and url not in seen and len(seen) < most:
            seen.add(url)
            chapters, url = pages[book, url]
            for c in chapters:
                last[c] = at
                at += 1
        out |= {(book, c): i for c, i in last.items()}
    return out


def test_multi_page_toc(spark, tmp_path):
    pages = {(1, "a"): (["x", "y"], "b"), (1, "b"): (["y", "z"], "c"), (1, "c"): (["x"], "a"), (2, "a"): ([], "a"), (3, "q"): (["k", "k"], "gone"), (4, "p"): (["m"], None)}
    rows = [(b, u, c, n) for (b, u), (c, n) in pages.items()] + [(None, "a", ["w"], None), (5, None, ["w"], None)]
    x = spark.createDataFrame(rows, "book int, url string, chapters array<string>, next string")
    starts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "q"), (4, "p"), (6, "a"), (5, None)], "book int, url string")
    for most in (2, 20):
        got = {(r.book, r.chapter): r.place for r in P.follow_pages(starts, x, "book", "url", "chapters", "next", most).collect()}
        want = toc_of(pages, [(1, "a"), (2, "a"), (3, "q"), (4, "p"), (6, "a")], most)
        rank = {}
        for (b, c), at in sorted(want.items(), key=lambda kv: (kv[0][0], kv[1])):
            rank[b, c] = sum(1 for k in rank if k[0] == b)
        assert got == rank
