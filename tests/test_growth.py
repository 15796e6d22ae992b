"""Queries against their SQL on odd rows, and that the work of each grows no faster than its input."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tomeflow.functions import names
from tomeflow.operators import phrases, samebook, textquality, tocalign
from tomeflow.plans import pages, registry
from tomeflow.sources import charset, tables, volumes
from tomeflow.streaming import health


def against_sql(spark, folder, name, *tables):
    """A query's rows and its SQL's on tables (name, frame) written below a folder."""
    con = duckdb.connect()
    for table, frame in tables:
        frame.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(folder))
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return sorted(map(tuple, got.select(*columns).collect()), key=repr), sorted(want.fetchall(), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("heading", ["token = &quot;a&quot;", "cut &amp", "a &amp;lt; b &lt; c &copy; d", "plain", "R&D &#39;x&#39;"])
def test_xpath_article_reads_references_as_its_sql(spark, tmp_path, heading):
    nav = "".join(f'<li><a href="/x{i}?a=1&amp;b=&quot;">L{i} &amp; &copy</a></li>' for i in range(3))
    html = f"<html><body><nav><ul>{nav}</ul></nav><article><h1>{heading}</h1><p>x</p></article><footer>f</footer></body></html>"
    pages = spark.createDataFrame([(1, "http://a/en/1", html)], "page_id long, url string, html string")
    got, want = against_sql(spark, tmp_path, "xpath_article", ("pages", pages))
    assert got == want


def test_near_source_pairs_shuffles_lists_not_pairs(spark, tmp_path):
    lines = [(s, p) for p in range(6) for s in range(9) if (s + p) % 4] * 2 + [(None, 1), (3, None), (77, 99)]
    lines = spark.createDataFrame(lines, "l_suppkey long, l_partkey long")
    got, want = against_sql(spark, tmp_path, "near_source_pairs", ("lineitem", lines))
    assert got == want and len(got) == 36
    joins = [x for x in plan_of(registry.queries()["near_source_pairs"](spark, str(tmp_path))).splitlines() if "Join" in x]
    assert joins and not any("l_partkey" in x for x in joins)


def test_same_book_compares_chapters_of_candidates_alone(spark):
    line = lambda i, k: f"Title{i} alpha{i} beta{i} " + " ".join(f"w{i}x{j}{k}" for j in range(40))
    books = [("a", "\n".join(line(i, "") for i in range(6))), ("b", "\n".join(line(i, "") for i in range(6)) + "\nend")]
    alone = [(f"z{n}", "\n".join(line(1000 * n + i, "q") for i in range(6))) for n in range(1, 4)]
    docs = spark.createDataFrame(books + alone + [("n", None), (None, books[0][1])], "id string, text string")
    seen = []
    real = samebook.bodies
    try:
        samebook.bodies = lambda d, key, text: (seen.extend(r[0] for r in d.select(key).collect()), real(d, key, text))[1]
        got = samebook.same_book(docs, "id", "text").collect()
    finally:
        samebook.bodies = real
    assert [tuple(r)[:2] for r in got] == [("a", "b")] and got[0].matches == 6
    assert sorted(seen) == ["a", "b"]


def test_alignment_meets_windows_by_place(spark):
    contents = spark.createDataFrame([(k, i, f"name {i}") for k in "pq" for i in range(24)] + [("p", 24, None)], "key string, no int, name string")
    windows = spark.createDataFrame([("p", "q", 0, 12), ("p", "q", 12, 999), ("p", "q", 30, 40), ("p", "q", 5, 5), ("p", "q", -3, 9)], "plan string, anchor string, first int, last int")
    found = tocalign.align(windows, contents)
    assert sorted(map(tuple, found.collect())) == [("p", "q", 0, 12, 0), ("p", "q", 12, 999, 0)]
    assert not [x for x in plan_of(found).splitlines() if "Join" in x and re.search(r"\bno#\d+ (>=|<)", x)]


def test_rows_go_to_python_in_bounded_batches(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(i, f"{i}" * 50_000) for i in range(10, 90)], "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    size = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
    batch = lambda df: df.select(size("text").alias("n")).agg(F.max("n")).first()[0]
    assert batch(tables.table(spark, str(tmp_path), "documents")) < 30
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    volumes.write(docs, "doc_id", "text", f"{tmp_path}/stored")
    assert batch(docs) < 30


def test_page_charsets_sends_python_bounded_batches_of_its_rows(spark, tmp_path, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    html = F.concat(F.lit('<html><head><meta charset="utf-8"></head><body>第'), F.repeat(F.lit("é"), 25_000), F.col("id").cast("string"))
    rows = spark.range(120).select(F.col("id").alias("page_id"), html.alias("html"))
    got, want = against_sql(spark, tmp_path, "page_charsets", ("pages", rows))
    assert got == want and len(got) == 120
    log = tmp_path / "batches"

    @F.pandas_udf("binary")
    def seen(text: pd.Series, name: pd.Series) -> pd.Series:
        with log.open("a") as f:
            f.write(f"{len(text)} {text.notna().sum()} {sum(len(x.encode()) for x in text if x is not None)}\n")
        return pd.Series([None if x is None else x.encode(n) for x, n in zip(text, name, strict=True)], dtype="object")

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(charset, "encoded", seen)
    again = registry.queries()["page_charsets"](spark, str(tmp_path)).select("page_id", "h", "charset", "exact")
    assert sorted(map(tuple, again.collect()), key=repr) == got
    batches = [tuple(map(int, x.split())) for x in log.read_text().splitlines()]
    assert sum(n for n, _, _ in batches) == 120 and sum(n for _, n, _ in batches) == 80
    assert max(size for _, _, size in batches) < 2 * tables.BATCH_BYTES


def test_pages_are_parsed_once_however_many_follow(spark, tmp_path):
    parsed = spark.sparkContext.accumulator(0)

    def count(urls):
        parsed.add(len(urls))
        return urls

    page = F.pandas_udf(count, "string").asNondeterministic()
    x = spark.createDataFrame([(1, f"u{i}", [f"c{i}"], f"u{i + 1}") for i in range(8)], "book int, url string, chapters array<string>, next string")
    starts = spark.createDataFrame([(1, "u0")], "book int, url string")
    got = pages.follow_pages(starts, x.withColumn("url", page("url")), "book", "url", "chapters", "next")
    assert got.count() == 8 and parsed.value == 8


def test_one_pattern_finds_what_the_trie_finds():
    rng = random.Random(3)
    for _ in range(300):
        pairs = [(p, f"<{p}>") for p in {"".join(rng.choices("ab.*é\n", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12))}]
        text = "".join(rng.choices("abc.*é\n", k=60))
        root = phrases.trie(pairs)
        begins = re.compile(f"[{re.escape(''.join(sorted(root)))}]" if root else r"(?!)")
        assert phrases.replacer(pairs)(text) == phrases.replaced(text, root, begins)


def test_a_chapters_number_is_read_once(spark):
    x = spark.createDataFrame([("第十二章a。",), ("第3章",), ("b!",), ("",), (None,), ("第千万回x",)], "t string")
    got = x.select(names.chapter_key(F.col("t")).alias("k"))
    want = [("第12章a", 12, "a"), ("第3章", 3, ""), ("b", None, "b"), ("", None, ""), (None, None, None), ("第10000000回x", 10_000_000, "x")]
    assert [tuple(r.k) for r in got.collect()] == want
    assert got._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_near_names_reads_its_tables_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Kettle lantern\nmarble"), (2, "kettles"), (3, None), (4, ""), (5, "\nbasket")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "kettle lanterns\nbasket"), (2, None)], "item_id long, text string")
    got, want = against_sql(spark, tmp_path, "near_names", ("documents", docs), ("benchmark", items))
    assert got == want and len(got) == 3
    assert "documents.parquet" not in plan_of(registry.queries()["near_names"](spark, str(tmp_path)))


def test_chapter_pairs_of_repeated_orders_null_places_and_ties(spark, tmp_path):
    orders = [(o, o // 4) for o in range(12)] + [(5, 1), (5, 1), (None, 1), (6, None)]
    lines = [(o, n, 10 * n + k, 7 * o + n, 0.01 * (o % 3)) for o in range(12) for k, n in enumerate([3, 1, 2][: 1 + o % 3])]
    lines += [(5, None, 1, 3, 0.02), (6, 2, None, 4, 0.02), (4, None, None, 1, 0.01), (None, 1, 1, 1, 0.1), (7, 1, 10, 8, None)]
    orders = spark.createDataFrame(orders, "o_orderkey long, o_custkey long")
    x = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_tax double")
    got, want = against_sql(spark, tmp_path, "chapter_pairs", ("orders", orders), ("lineitem", x))
    assert got == want and len(got) > 8 and len({g[2] for g in got}) == 2
    tied = [(o, 1, 1, s, 0.1) for o, ss in ((1, (1, 2, 3)), (2, (2, 8, 4))) for s in ss]
    two = spark.createDataFrame([(1, 1), (2, 1)], "o_orderkey long, o_custkey long")
    seen = set()
    for i, rows in enumerate((tied, tied[::-1])):
        at = tmp_path / f"ties{i}"
        two.write.parquet(f"{at}/orders.parquet")
        spark.createDataFrame(rows, x.schema).coalesce(1).write.parquet(f"{at}/lineitem.parquet")
        seen.add(tuple(map(tuple, registry.queries()["chapter_pairs"](spark, str(at)).collect())))
    assert len(seen) == 1


@pytest.mark.parametrize(("piece", "grams"), [(textquality.PIECE, textquality.MOST_GRAMS), (7, textquality.MOST_GRAMS), (7, 3)])
def test_similar_titles_writes_no_candidates(spark, tmp_path, monkeypatch, piece, grams):
    monkeypatch.setattr(textquality, "PIECE", piece)
    monkeypatch.setattr(textquality, "MOST_GRAMS", grams)
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdef 123", k=rng.randint(1, 60))) for _ in range(12)]
    titles = [b[:i] + rng.choice("xyz") + b[i:] for b in base for i in rng.sample(range(len(b) + 1), min(6, len(b)))] + base + ["", "a", "A", "!", "b", "ab", "Ab!", "\nx"]
    rows = [(i, t, rng.choice(["en", "de"])) for i, t in enumerate(titles)] + [(900, titles[0], None), (901, None, "en"), (None, titles[3], "en"), (902, "lone title", "fr"), (902, "lone titles", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, want = against_sql(spark, tmp_path, "similar_titles", ("documents", docs))
    assert got == want and len(got) > 40
    plan = plan_of(registry.queries()["similar_titles"](spark, str(tmp_path)))
    assert not re.search(r"Join.*\bgram", plan) and "documents.parquet" not in plan
    assert registry.queries()["dup_clusters"](spark, str(tmp_path)).count() == len({x for a, b, _ in want for x in (a, b)})


def test_same_book_leaves_out_candidates_that_cannot_share_enough(spark):
    own = lambda k, n: [f"own{k}x{i}" for i in range(n)]
    rows = [(k, ["aaaa", *own(k, 5)]) for k in range(6)] + [(10, ["b1bb", "b2bb", "b3bb", "b4bb", "b5bb", "own10"]), (11, ["b1bb", "b2bb", "b3bb", "b4bb", "b5bb"])]
    rows += [(20 + k, [f"c{i}cc" for i in range(5)] + own(20 + k, 3 * k)) for k in range(3)] + [(30 + k, [f"{c}{i}{c}" for c in ("dd", "ee") for i in range(3)] + own(30 + k, 3)) for k in range(2)]
    toc = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "key int, titles array<string>, n int")
    got = {tuple(r) for r in samebook._candidates(toc).collect()}
    alike = {(a, b) for a, x in rows for b, y in rows if a < b and len({*x} & {*y}) >= max(5, 0.6 * len({*x} | {*y}))}
    assert alike <= got and len(alike) == 2 and got <= alike | {(30, 31), (21, 22)}


def test_suspects_as_their_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(health, "SHARES", 3)
    rng = random.Random(2)
    rows = [(i, i * 9_000 + rng.randint(-5_000, 5_000), rng.randint(0, 40), rng.choice(["error", "view", None])) for i in range(900)]
    rows += [(901, 5_000_000, None, "error"), (None, 5_000_000, 3, "error"), (903, 5_000_000, -4, "error"), (904, 5_000_000, -4, "error")]
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).cast("timestamp_ntz")
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string").select("event_id", at.alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    got, want = against_sql(spark, tmp_path, "stream_suspects", ("events", events))
    assert got == want and len(got) > 20 and (-4, 904, 2) in got


def test_suspects_call_state_for_batches_not_for_events():
    calls, kept, timers = [], {}, set()

    class Handle:
        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return kept.get(0)

        def update(self, v):
            calls.append("update")
            kept[0] = v

        def clear(self):
            kept.clear()

        def registerTimer(self, at):
            calls.append("timer")
            timers.add(at)

    times = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 10_000})()
    p = health.Suspects(2, 500, 10_000)
    p.init(Handle())
    rows = [(u, 1_000_000 + 1_000_000 * k, 100 * u + k, k % 3 > 0) for u in range(50) for k in range(12)]
    for half in (rows[::2], rows[1::2] + rows[:9]):
        assert list(p.handleInputRows((0,), iter([pd.DataFrame(half, columns=["user_id", "us", "event_id", "failed"])]), times)) == []
    assert min(timers) < 1_000
    got = [tuple(x) for f in p.handleExpiredTimer((0,), times, None) for x in f.itertuples(index=False)]
    assert got == [(u, 100 * u + k, 2) for u in range(50) for k in (2, 5, 8)]
    assert len(calls) <= 10 and len(kept[0][1]) == 100 * health.WAITING.itemsize
