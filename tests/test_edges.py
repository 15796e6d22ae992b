"""Odd rows: nulls, ties, blanks and empty tables in the general operators."""

from pyspark.sql import functions as F

from tomeflow.functions import text as X
from tomeflow.operators import extraction as E
from tomeflow.operators import jsonpath
from tomeflow.operators import relational as R
from tomeflow.operators import state as S
from tomeflow.operators import textquality as Q
from tomeflow.plans import texts
from tomeflow.sources import sinks
from tomeflow.streaming import events as V


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_page_orders_nulls_and_ties(spark):
    x = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, None)], "id int, q int")
    order = [F.col("q").desc_nulls_last(), F.desc("id")]
    assert [r.id for r in R.page(x, order, 1, 3).collect()] == [3, 2, 4]
    assert [r.id for r in R.page(x, order, 2, 3).collect()] == [1]
    assert R.page(x.where("false"), order, 1, 3).count() == 0


def test_version_wins_is_a_fold_in_order(spark):
    data = [("a", 1, 5, "x"), ("a", 2, 3, "y"), ("b", 1, 5, "x"), ("b", 2, 0, "y"), ("c", 1, 2, "x"), ("c", 2, 2, "y")]
    x = spark.createDataFrame(data, "k string, pos long, stamp long, v string")
    assert rows(R.version_wins(x, "k", "stamp", "pos", "v"), "k", "v") == [("a", "x"), ("b", "y"), ("c", "y")]


def test_budget_skips_what_is_too_big(spark):
    x = spark.createDataFrame([("a", 1, 50), ("a", 2, 40), ("a", 3, 10), ("b", 1, 99)], "k string, o int, n int")
    assert rows(R.budget_fold(x, "k", "o", "n", 60), "k", "o") == [("a", 1), ("a", 3)]


def test_identity_and_urls(spark):
    x = spark.createDataFrame([(" 《《Ａx》》 ", "HTTPS://www.m.Example.org:8080/a/#f"), ("\tt", "no url"), (None, None)], "t string, u string")
    got = x.select(X.identity_title(F.col("t")), X.url_station(F.col("u")), X.url_normal(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("《ax》", "example.org", "HTTPS://www.m.Example.org:8080/a"), ("\tt", None, "no url"), (None, None, None)]


def test_upsert_keeps_what_is_null_in_the_new_row(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "z")], "k int, v string")
    assert rows(sinks.upsert(a, b, ["k"]), "k", "v") == [(1, "x"), (2, "y"), (3, "z")]
    assert rows(sinks.insert_absent(a, b, ["k"]), "k") == [(1,), (2,), (3,)]


def test_drift_of_equal_tables_is_empty(spark):
    a = spark.createDataFrame([(1, None), (2, 3)], "k int, n int")
    assert sinks.drift(a, a, ["k"]).count() == 0


def test_selectors_on_tag_soup(spark):
    html = '<div class="a b"><p>x &lt; y<p>z</div><ul><li><a href="/1">one</a><li><a>two</a></ul>'
    assert E.select(html, "div.a@text") == ["x < yz"] and E.select(html, "div.a > p@text") == ["x < y", "z"]
    assert E.select(html, "li a@href") == ["/1"]
    assert E.select("", "a@href") == [] and E.select("<", "a@href") == []


def test_selectors():
    html = '<ul><li>one<li class="x y">two <b>2</b><li>three</ul><p id="q">a<br>b<table><tr><td>1<td>2<tr><td>3</table><a href="/s/1.html?x">l</a>'
    want = {
        "li@text": ["one", "two 2", "three"], "li.x.y@ownText": ["two"], "li + li@text": ["two 2", "three"], "li.x ~ li@text": ["three"],
        "ul > b@text": [], "li > b@text": ["2"], "li:nth-child(2)@class": ["x y"], "li:not(.x)@text": ["one", "three"], "li:contains(thr)@text": ["three"],
        "li:has(b)@html": ["two <b>2</b>"], "li:last-child@all": ["<li>three</li>"], "td@text!-1": ["3"], "tr td:first-child@text": ["1", "3"],
        "a[href^=/s/]@href": ["/s/1.html?x"], "a[href~=[.]html]@text": ["l"], "#q@text": ["ab"], "li@text!7": [],
    }
    assert {k: E.select(html, k) for k in want} == want


def test_json_paths(spark):
    doc = '{"store": {"book": [{"t": "a", "p": 8}, {"t": "b", "p": 12, "x": null}, {"t": "c"}], "b": {"p": 19.5}}}'
    want = {
        "$.store.book[*].t": ["a", "b", "c"], "$..p": ["8", "12", "19.5"], "$.store.book[-1].t": ["c"], "$.store.book[0:2].t": ["a", "b"],
        "$.store.book[0,2].t": ["a", "c"], "$.store.book[?(@.p > 8)].t": ["b"], "$.store.book[?(@.p)].t": ["a", "b"], "$..book[?(@.t == 'a' || @.p >= 12)].p": ["8", "12"],
        "$.store['b']['p']": ["19.5"], "$.none[*]": [], "$.store.book[?(!(@.p))].t": ["c"], "$.store.book[?(@.t =~ /[bc]/)].t": ["b", "c"], "$.store.b": ['{"p":19.5}'],
        "$.store.book[(@.length-1)].t": ["c"], "$.store.book.length()": ["3"], "$..book[?(@.t in ['a', 'c'])].t": ["a", "c"], "$..book[?(@.t nin ['a'] && (@.p || !(@.p)))].t": ["b", "c"],
        "$.store.book[?(@.p > $.store.book[0].p)].t": ["b"], "$.store.book[?(@.x == null)].t": ["b"], "$.store.book[?(@.t == 'x&&y' || @.t == \"a\")].p": ["8"], "$..[?(@.p == 19.5)].p": ["19.5"],
    }
    x = spark.createDataFrame([(doc,), ("no json",), (None,)], "j string")
    for path, values in want.items():
        assert [r[0] for r in x.select(jsonpath.find_all(F.col("j"), path)).collect()] == [values, [], []], path
    assert x.select(E.compile_rule("$..t", F.col("j"))).first()[0] == "a\nb\nc"


def test_html_to_text(spark):
    x = spark.createDataFrame([("<p>if a < b then c > d</p>x<!-- open",), ("<b>1</b><script>var t='</p>'",), ("a&amp;b<br/>c",), (None,)], "h string")
    assert [r[0] for r in x.select(E.html_to_text(F.col("h"))).collect()] == ["if a < b then c > d\nx", "1", "a&b\nc", None]


def test_rules_find_null_where_nothing_is(spark):
    x = spark.createDataFrame([('{"k": null}',), ("{}",), (None,), ('{"k": " v "}',)], "j string")
    got = [r[0] for r in x.select(E.compile_rule("$.none||$.k", F.col("j"))).collect()]
    assert got == [None, None, None, "v"]


def test_verdicts_of_empty_and_null_texts(spark):
    x = spark.createDataFrame([(1, ""), (2, None), (3, "short...")], "id int, t string")
    assert rows(Q.prepare_verdict(x, "id", "t"), "id", "verdict") == [(1, "empty"), (2, "empty"), (3, "preview")]
    assert Q.dropped_lines(x, "id", "t").count() == 0


def test_last_write_wins_breaks_ties(spark):
    x = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (2, None, 1, "c")], "k int, ts int, id int, v string")
    assert rows(S.last_write_wins(x, ["k"], "ts", "id", ["v"]), "k", "v") == [(1, "b"), (2, "c")]


def test_dup_clusters_of_a_long_chain(spark, tmp_path):
    """Each title is near to the next only; the last is 19 hops from the least id."""
    import random

    line = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=80))
    docs = spark.createDataFrame([(i, line[2 * i : 2 * i + 20], "en") for i in range(20)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(texts.dup_clusters(spark, str(tmp_path)), "doc_id", "cluster")
    assert got == sorted(((i, 0) for i in range(20)), key=repr)


def test_volumes_are_next_fit(spark):
    x = spark.createDataFrame([("a", 1, 6), ("a", 2, 5), ("a", 3, 4), ("a", 4, 30), ("a", 5, 1), ("b", 1, None), ("b", 2, 10), (None, 1, 3)], "k string, o int, n int")
    got = rows(sinks.volumes(x, "k", "o", "n", 10), "k", "o", "volume", "volume_offset")
    assert got == sorted([("a", 1, 0, 0), ("a", 2, 1, 0), ("a", 3, 1, 5), ("a", 4, 2, 0), ("a", 5, 3, 0), ("b", 1, 0, 0), ("b", 2, 0, 0), (None, 1, 0, 0)], key=repr)
    assert sinks.volumes(x.where("false"), "k", "o", "n", 10).count() == 0


def test_streams_of_folders_and_nothing(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "many" / "events.parquet"))
    e.where("false").write.parquet(str(tmp_path / "none" / "events.parquet"))
    assert V.run_once(spark, V.last_write(V.read_events(spark, str(tmp_path / "many"))), "complete", str(tmp_path)).count() == e.select("user_id").distinct().count()
    assert V.run_once(spark, V.first_of_day(V.read_events(spark, str(tmp_path / "none"))), "append", str(tmp_path)).count() == 0


def test_suspects_across_batches(spark, tmp_path):
    """Failures in several batches, out of order within what may come late; too late, null and repeated events."""
    from tomeflow.streaming import health as H

    at = lambda minute: f"2024-05-01 {minute // 60:02d}:{minute % 60:02d}:00"
    batches = [
        [(1, at(10), 7, "error"), (3, at(30), 7, "error"), (4, at(10), 8, "error"), (4, at(10), 8, "error"), (90, None, 7, "error"), (91, at(20), None, "error")],
        [(2, at(20), 7, "error"), (5, at(12), 8, "view"), (6, at(14), 8, "error"), (7, at(15), 8, None), (8, at(60), 7, "error")],
        [(9, at(200), 7, "error"), (10, at(300), 9, "view"), (11, at(35), 7, "error")],
        [(14, at(400), 9, "view")],
        [(12, at(5), 7, "error"), (13, at(1200), 9, "view")],
    ]
    path = str(tmp_path / "events")
    for b in batches:
        rows = spark.createDataFrame([(*r, 1.0, "{}") for r in b], "event_id long, ts string, user_id long, event_type string, value double, props string")
        rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(V.EVENTS).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    before = spark.conf.get(H.PROVIDER, None)
    with H.timed_state(spark):
        out = V.run_once(spark, H.suspects(stream, "60 minutes", 2, 20 * 60_000, 120 * 60_000), "append", str(tmp_path))
    # 7: suspect at 20, still at 30 and 35, anew at 60; forgotten by 200. 8: cleared at 12 and 15.
    assert rows_of_suspects(out) == [(7, 2, 2), (7, 8, 5)]
    assert spark.conf.get(H.PROVIDER, None) == before


def rows_of_suspects(out):
    return sorted(tuple(r) for r in out.select("user_id", "event_id", "failures").collect())
