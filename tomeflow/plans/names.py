"""Registered queries of names, chapter keys, urls, candidates, near titles and plans of tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import urls as U
from ..operators import backfill, matching
from ..sources.tables import table as t

KNOWN = ["click", "error"]


def _chinese(n):
    """A number below a hundred million in Chinese digits, without zeros inside."""
    digits = F.array(*[F.lit(c) for c in "零一二三四五六七八九"])
    four = lambda x: F.concat(*[F.when(F.floor(x / p) % 10 == 0, "").otherwise(F.concat(F.get(digits, (F.floor(x / p) % 10).cast("int")), F.lit(u))) for p, u in ((1000, "千"), (100, "百"), (10, "十"), (1, ""))])
    return F.when(n == 0, "零").otherwise(F.concat(F.when(n >= 10_000, F.concat(four(F.floor(n / 10_000)), F.lit("万"))).otherwise(""), four(n % 10_000)))


def chapter_keys(s, d):
    """Orders as chapters numbered in Chinese, and their key in Arabic digits."""
    title = F.concat(F.lit("《第 "), _chinese(F.col("o_orderkey")), F.lit("　章 "), F.col("o_orderpriority"), F.lit("！》"))
    return t(s, d, "orders").select("o_orderkey", N.chapter_key(N.title_normal(title)).alias("k")).select("o_orderkey", "k.key", "k.number", "k.rest")


def near_names(s, d):
    """Words of the benchmark and words of the documents' first lines that are nearly equal."""
    words = lambda name, text: t(s, d, name).select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))).alias("w")).distinct()
    return matching.near_titles(words("benchmark", F.col("text")), words("documents", F.substring_index("text", "\n", 1)))


def absolute_links(s, d):
    """The links of a page's nav as whole urls."""
    x = t(s, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), F.lit(1))).alias("href"))
    return x.groupBy("page_id", U.absolute_url("href", "url").alias("link")).agg(F.count("*").alias("n"))


def url_refusals(s, d):
    """Urls of pages, plain and with what a policy refuses."""
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    ways = [F.col("url"), F.concat(F.lit("https://"), rest), F.concat(F.lit("https://u@"), rest), F.concat(F.lit("https://127.0.0.1/"), rest), F.concat(F.lit("https:// "), rest), F.regexp_replace(F.concat(F.lit("https://"), rest), "^(https://[^/]*)", "$1:443")]
    return t(s, d, "pages").select("page_id", U.refusal(F.element_at(F.array(*ways), (F.col("page_id") % 6 + 1).cast("int"))).alias("refusal"))


def query_encoding(s, d):
    """Benchmark texts as components of a query and as fields of a form."""
    one = lambda form: U.query_text("text", F.lit("utf-8"), F.lit(form))
    return t(s, d, "benchmark").select("item_id", one(False).alias("component"), one(True).alias("form"))


def file_names(s, d):
    """File names of documents by their first line and source."""
    return t(s, d, "documents").select("doc_id", N.file_name(F.split("text", "\n")[0], F.col("source")).alias("name"))


def candidates_clean(s, d):
    """Of a customer's first twelve orders, by key, the distinct states with priorities, as cleaned candidates."""
    one = F.struct(F.col("o_orderstatus").alias("title"), F.concat(F.lit(" "), "o_orderpriority").alias("author"), F.col("o_orderstatus").alias("category"), F.lit(None).cast("string").alias("word_count"), F.lit("").alias("why"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("c")))), lambda x: x["c"])  # a customer's orders
    x = t(s, d, "orders").groupBy("o_custkey").agg(lists.alias("c")).select("o_custkey", N.clean_candidates(F.col("c")).alias("c"))
    return x.select("o_custkey", F.size("c").alias("n"), F.array_join(F.transform("c", lambda x: F.concat(x["title"], F.lit("/"), x["author"])), ",").alias("names"))


def note_codec(s, d):
    """Events as notes of known reasons and a text, written and read."""
    x = t(s, d, "events").select("event_id", N.note(F.array("event_type"), F.col("props"), KNOWN).alias("note"))
    return x.select("event_id", "note", N.read_note(F.col("note"), KNOWN).alias("r")).select("event_id", "note", F.array_join("r.reasons", ",").alias("reasons"), "r.text")


def author_bridge(s, d):
    """Customers without orders, found by nation and balance where these are one supplier's alone."""
    key = lambda p: F.concat(F.col(f"{p}_nationkey").cast("string"), F.lit("x"), F.floor(F.col(f"{p}_acctbal") / 500).cast("string"))
    tasks = t(s, d, "customer").select(F.col("c_custkey").alias("task"), F.col("c_name").alias("title"), key("c").alias("author"))
    seen = t(s, d, "customer").join(t(s, d, "orders").where("o_orderdate >= '1998-01-01'"), F.expr("c_custkey = o_custkey"), "left_semi").select(F.col("c_name").alias("title"))
    return matching.author_bridge(tasks, seen, t(s, d, "supplier").select(F.col("s_name").alias("url"), key("s").alias("author")))


def backfill_plan(s, d):
    """Documents of good quality: those to be asked for, and those that an order in process or their length skips."""
    wanted = t(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    tasks = t(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    artifacts = t(s, d, "documents").where("n_chars < 500").select(F.col("doc_id").alias("id"))
    return backfill.plan(wanted, tasks, artifacts, "v1")


_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower({0}), '[a-z]{{3,}}')) AS w FROM {1}"
_ASCII = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE url_encode(c) END), '')"
_PART = "regexp_replace(regexp_replace({0}, '[\\\\/:*?\"<>|\\x00-\\x1f\\x7f]', '', 'g'), '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g')"

SQL = {
    "chapter_keys": "SELECT o_orderkey, '第' || o_orderkey || '章' || p AS key, o_orderkey AS number, p AS rest FROM (SELECT o_orderkey, replace(lower(o_orderpriority), ' ', '') AS p FROM orders)",
    "near_names": f"SELECT a, b, tier FROM (SELECT x.w AS a, y.w AS b, CASE WHEN x.w = y.w THEN 0 WHEN least(length(x.w), length(y.w)) >= 4 AND (contains(x.w, y.w) OR contains(y.w, x.w)) THEN 2 WHEN least(length(x.w), length(y.w)) >= 4 AND abs(length(x.w) - length(y.w)) <= 2 AND levenshtein(x.w, y.w) <= 2 THEN 3 END AS tier FROM ({_WORDS.format('text', 'benchmark')}) x, ({_WORDS.format('string_split(text, chr(10))[1]', 'documents')}) y) WHERE tier IS NOT NULL",
    "absolute_links": f"SELECT page_id, regexp_extract(url, '^https?://[^/]*') || {_ASCII.format('href')} AS link, count(*) AS n FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1, 2",
    "url_refusals": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN CASE WHEN url LIKE 'https:%' THEN NULL ELSE 'scheme' END WHEN 2 THEN 'authority' WHEN 3 THEN 'address' WHEN 4 THEN 'characters' END AS refusal FROM pages",
    "query_encoding": "SELECT item_id, replace(replace(replace(replace(replace(u, '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')') AS component, replace(replace(replace(u, '%2A', '*'), '~', '%7E'), '%20', '+') AS form FROM (SELECT item_id, url_encode(text) AS u FROM benchmark)",
    "file_names": "SELECT doc_id, regexp_replace(substr(regexp_replace(trim(x), '[-\\s]+$', ''), 1, 80), '[-\\s]+$', '') || '.txt' AS name FROM (SELECT doc_id, " + _PART.format("coalesce(nullif(trim(string_split(text, chr(10))[1]), ''), '未命名') || '-' || coalesce(nullif(trim(source), ''), '佚名')") + " AS x FROM documents)",
    "candidates_clean": "SELECT o_custkey, count(*) AS n, string_agg(x, ',' ORDER BY f) AS names FROM (SELECT o_custkey, o_orderstatus || '/' || o_orderpriority AS x, min(rn) AS f FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 12 GROUP BY 1, 2) GROUP BY 1",
    "note_codec": "SELECT event_id, CASE WHEN k THEN event_type || chr(10) ELSE '' END || props AS note, CASE WHEN k THEN event_type ELSE '' END AS reasons, props AS text FROM (SELECT *, event_type IN ('click', 'error') AS k FROM events)",
    "author_bridge": "WITH c AS (SELECT c_custkey, c_nationkey || 'x' || CAST(floor(c_acctbal / 500) AS INT) AS k, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '1998-01-01') AS seen FROM customer), "
    "s AS (SELECT regexp_replace(s_nationkey || 'x' || CAST(floor(s_acctbal / 500) AS INT), '[^a-z0-9]', '', 'g') AS k, min(s_name) AS url FROM supplier GROUP BY 1 HAVING count(DISTINCT s_name) = 1) "
    "SELECT c_custkey AS task, url FROM c JOIN s ON s.k = regexp_replace(c.k, '[^a-z0-9]', '', 'g') WHERE NOT seen",
    "backfill_plan": "WITH x AS (SELECT DISTINCT doc_id AS id, CASE WHEN doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN 'task' WHEN doc_id IN (SELECT doc_id FROM documents WHERE n_chars < 500) THEN 'artifact' END AS reason FROM labels WHERE quality = 1) SELECT id, reason, CASE WHEN reason IS NULL THEN id || ':v1:' END AS enqueue_key FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY id) AS rn FROM x) WHERE reason IS NOT NULL OR rn <= 500",
}

QUERIES = {f.__name__: f for f in (chapter_keys, near_names, absolute_links, url_refusals, query_encoding, file_names, candidates_clean, note_codec, author_bridge, backfill_plan)}
