"""Identity, url, text-quality, extraction and state queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as NM
from ..functions import text as X
from ..operators import components as C
from ..operators import extraction as E
from ..operators import relational as R
from ..operators import state as S
from ..operators import textquality as Q
from ..sources import sinks
from ..sources.tables import chapters, table as t
from ..streaming import events as V

TITLE = "string_split(text, chr(10))[1]"


def _titles(s, d):
    return t(s, d, "documents").withColumn("title", F.split("text", "\n")[0])


def identity_keys(s, d):
    return _titles(s, d).select("doc_id", X.identity_title(F.col("title")).alias("title_key"), X.identity_author(F.concat(F.lit("  "), F.col("source"))).alias("author_key"))


def loose_keys(s, d):
    return t(s, d, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "").alias("loose"), X.loose_key(F.col("p_brand")).alias("brand"))


def twin_detection(s, d):
    """Titles stored under several spellings that are one by their loose key."""
    x = _titles(s, d).select("title", F.regexp_replace(F.lower("title"), "[^a-z0-9]", "").alias("k")).where("k <> ''").distinct()
    return x.groupBy("k").agg(F.count("*").alias("spellings")).where("spellings > 1")


def author_match_pairs(s, d):
    c = t(s, d, "customer").select(F.substring("c_name", 10, 9).alias("k"), "c_custkey")
    sup = t(s, d, "supplier").select(F.substring("s_name", 10, 9).alias("k"), "s_suppkey")
    return c.join(sup, "k").select("c_custkey", "s_suppkey", F.levenshtein(F.concat(F.lit("c"), "k"), F.concat(F.lit("s"), "k")).alias("edits"))


def url_host_station(s, d):
    return t(s, d, "pages").select("page_id", X.url_host(F.col("url")).alias("host"), X.url_station(F.col("url")).alias("station"))


def url_normalize(s, d):
    return t(s, d, "pages").select("page_id", X.url_normal(F.col("url")).alias("url"))


def url_upgrade_collision(s, d):
    """Pages reached by http of which an https row exists too are dropped."""
    x = t(s, d, "pages").withColumn("u", F.regexp_replace(X.url_normal(F.col("url")), "^http://", "https://"))
    x = x.withColumn("native", F.startswith("url", F.lit("https://")).cast("int"))
    x = x.withColumn("any_native", F.max("native").over(Window.partitionBy("u")))
    return x.where("native = 1 or any_native = 0").select("page_id", "u")


def backoff_curves(s, d):
    n = (F.col("event_id") % 12).cast("int")
    return t(s, d, "events").select("event_id", X.backoff(n, 5, 3600).alias("wait2"), X.backoff(n, 1, 100000, 4).alias("wait4"))


def fail_prefix_codec(s, d):
    n = (F.col("event_id") % 5).cast("int")
    e = t(s, d, "events").withColumn("error", F.when(n > 0, X.set_fail_count(n, F.col("event_type"))).otherwise(F.col("event_type")))
    return e.select("event_id", X.fail_count(F.col("error")).alias("fails"), X.set_fail_count(X.fail_count(F.col("error")) + 1, F.lit("x")).alias("next"))


def chapter_number(s, d):
    """Orders' sizes as numbers below ten thousand in Chinese digits, read back."""
    n = (F.col("o_totalprice") % 10000).cast("int")
    digit = lambda p, unit: F.when(F.floor(n / p) % 10 == 0, F.when((n % p > 0) & (n >= p * 10) & (F.floor(n * 10 / p) % 10 > 0), "零").otherwise("")).otherwise(F.concat(F.substring(F.lit(X.DIGITS), (F.floor(n / p) % 10).cast("int") + 1, F.lit(1)), F.lit(unit)))
    name = F.concat(F.lit("第"), digit(1000, "千"), digit(100, "百"), digit(10, "十"), digit(1, ""), F.lit("章"))
    return t(s, d, "orders").select("o_orderkey", NM.number_of(F.regexp_extract(name, "^第(.+)[章回]$", 1)).alias("number"))


def char_ngrams_topk(s, d):
    x = _titles(s, d).select(F.explode(X.char_ngrams(F.regexp_replace(F.lower("title"), "[^a-z0-9]", ""), 4)).alias("gram"))
    return x.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(50)


def similar_titles(s, d):
    x = _titles(s, d).select("doc_id", "lang", F.regexp_replace(F.lower("title"), "[^a-z0-9]", "").alias("title"))
    return Q.similar_titles(x, "doc_id", "title", "lang", 0.7, 2)


def dup_clusters(s, d):
    """Single-link clusters of similar titles: labels spread to a fixpoint, each round a small join."""
    return C.least_labels(similar_titles(s, d).select("a", "b"), "a", "b", _shared(s)).toDF("doc_id", "cluster")


def clip_ellipsis(s, d):
    return t(s, d, "documents").select("doc_id", X.clip(F.col("text"), 80).alias("head"))


def control_squash(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(X.squash_controls(F.col("text"))).alias("h"))


def genre_rules(s, d):
    c = F.col("p_type")
    g = F.when(c.rlike("BRASS|COPPER"), "warm").when(c.rlike("STEEL|TIN"), "cold").otherwise("other")
    return t(s, d, "part").groupBy(g.alias("genre")).agg(F.count("*").alias("n"))


def line_drop_rules(s, d):
    return Q.dropped_lines(t(s, d, "documents"), "doc_id", "text")


def line_dedupe_long(s, d):
    return Q.dedupe_long_lines(t(s, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"))


def template_lines(s, d):
    return Q.template_lines(t(s, d, "documents"), "doc_id", "text")


def prepare_verdict(s, d):
    return Q.prepare_verdict(t(s, d, "documents"), "doc_id", "text")


def mojibake_ratio(s, d):
    return t(s, d, "documents").select("doc_id", F.round(Q.wrong_decode_ratio(F.col("text")), 6).alias("ratio"))


def benchmark_contamination(s, d):
    return Q.contained_items(t(s, d, "documents"), "doc_id", t(s, d, "benchmark"), "item_id", n=8)


def readability(s, d):
    n = F.char_length(F.regexp_replace("text", "[ \\t\\r\\n]", ""))
    return t(s, d, "documents").groupBy(F.when(n < 500, "short").otherwise("readable").alias("verdict")).agg(F.count("*").alias("n"))


def content_html_to_text(s, d):
    return t(s, d, "pages").select("page_id", E.html_to_text(F.col("html")).alias("content"))


def css_title(s, d):
    return E.extract(t(s, d, "pages"), "html", {"title": "title@text", "heading": "article h1@text"}, core=("title",)).select("page_id", "title", "heading")


def css_links(s, d):
    x = t(s, d, "pages").select("page_id", F.posexplode(E.select_all(F.col("html"), "nav li a@href")).alias("place", "href"))
    return x


def toc_links_last_wins(s, d):
    w = Window.partitionBy("page_id", "href").orderBy(F.desc("place"))
    return css_links(s, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("page_id", "href", "place")


def jsonpath_child(s, d):
    return t(s, d, "events").select("event_id", E.compile_rule("$.k", F.col("props")).alias("k"))


def template_render(s, d):
    rule = "https://example.org/{{$.k}}?x={{$.none}}||none"
    return t(s, d, "events").select("event_id", E.compile_rule(rule, F.col("props")).alias("url"))


def regex_suffix(s, d):
    return t(s, d, "events").select("event_id", E.compile_rule("$.k##[0-4]##*", F.col("props")).alias("masked"))


def or_first_nonblank(s, d):
    x = E.compile_rule("$.none||$.k", F.col("props"))
    return t(s, d, "events").select("event_id", x.alias("v"))


def and_merge(s, d):
    return t(s, d, "events").select("event_id", E.compile_rule("$.k&&$.none&&$.k", F.col("props")).alias("v"))


def aio_regex_list(s, d):
    x = E.regex_rows(t(s, d, "pages").select("page_id", "html"), "html", '<a href="([^"]*)">([^<]*)</a>', 2, ["href", "name"])
    return x.select("page_id", "item_no", "href", "name")


def veto_clauses(s, d):
    """Candidates whose text holds a vetoed term outside a negated clause."""
    clause = F.split(F.lower("text"), "[.,;!?\\n]")
    hit = F.exists(clause, lambda c: F.contains(c, F.lit("tion")) & ~F.contains(c, F.lit(" not ")))
    return t(s, d, "documents").select("doc_id", F.when(hit, "veto").otherwise("pass").alias("verdict"))


def rerank_top10(s, d):
    x = t(s, d, "documents").join(t(s, d, "labels"), "doc_id")
    score = 2 * F.col("quality") - 3 * F.col("toxic") + F.least(F.col("n_chars"), F.lit(4000)) / 4000
    return x.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score")


def lww_state(s, d):
    return S.last_write_wins(t(s, d, "events"), ["user_id"], "ts", "event_id", ["event_id", "event_type"])


def rate_limit_windows(s, d):
    x = S.window_counts(t(s, d, "events"), ["event_type"], "ts", 60, 2)
    return x.select("event_type", F.unix_timestamp("window_start").alias("window_start"), "attempts", "allowed", "retry_after_s")


def session_gap(s, d):
    x = S.sessions(t(s, d, "events"), "user_id", "ts", 720)
    return x.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def stale_reclaim_transition(s, d):
    o = t(s, d, "orders")
    o = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("as_of")))).withColumn("tries", F.col("o_orderkey") % 4)
    return S.reclaim(o, "o_orderstatus", "o_orderdate", "tries", F.col("as_of"), 365, 3).groupBy("o_orderstatus", "next_status").agg(F.count("*").alias("n"))


def append_detection(s, d):
    turns = t(s, d, "conversations")
    known = S.prefix_state(turns.where("conv_id % 3 <> 0"), "conv_id", "turn", "text", 3)
    known = known.withColumn("h", F.when(F.col("conv_id") % 5 == 0, F.lit("x")).otherwise(F.col("h")))
    return S.append_state(turns, "conv_id", "turn", "text", known)


def chapter_split(s, d):
    x = t(s, d, "documents").select("doc_id", F.regexp_replace("text", "\\n", F.concat(F.lit("\n第"), F.col("doc_id").cast("string"), F.lit("章 \n"))).alias("text"))
    return chapters(x, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("chapters"), F.min("start_byte").alias("first"), F.max("end_byte").alias("bytes"))


def volume_pack(s, d):
    x = t(s, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return sinks.volumes(x, "source", "doc_id", "bytes", 20000).select("source", "doc_id", F.col("volume").cast("long").alias("volume"), "volume_offset")


def capacity_running(s, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    x = t(s, d, "lineitem").withColumn("used", F.sum("l_quantity").over(w)).where("used <= 500")
    return x.groupBy("l_suppkey").agg(F.count("*").alias("fit"), F.max("used").alias("used"))


def snapshot_orphans(s, d):
    p = t(s, d, "part").select(F.col("p_partkey").alias("k"))
    used = t(s, d, "lineitem").where("l_shipdate >= '1998-06-01'").select(F.col("l_partkey").alias("k"))
    return p.join(used, "k", "left_anti")


def upsert_orders(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    a = o.where("o_orderkey % 3 <> 0")
    b = o.where("o_orderkey % 3 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.lit("X")))
    return sinks.upsert(a, b, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def insert_absent_customers(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_mktsegment")
    out = sinks.insert_absent(c.where("c_custkey % 2 = 0"), c.withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])
    return out.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def _shared(s):
    """The cluster's shared folder; where it is unset, one below the warehouse, which is shared too."""
    return s.conf.get("spark.checkpoint.dir", None) or f"{s.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"


def stream_tumbling(s, d):
    rows = V.run_once(s, V.tumbling(V.read_events(s, d)), "complete", _shared(s))
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", "total")


def stream_lww(s, d):
    return V.run_once(s, V.last_write(V.read_events(s, d)), "complete", _shared(s))


def stream_first_of_day(s, d):
    return V.run_once(s, V.first_of_day(V.read_events(s, d)), "append", _shared(s))


def stream_circuits(s, d):
    return V.run_once(s, V.circuits(V.read_events(s, d)), "append", _shared(s))


HOST = "lower(nullif(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), ''))"
NORMAL = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '')"
LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
REASON = r"CASE WHEN regexp_matches(line, '(?i)all rights reserved|licensed under|released under') THEN 'rights' WHEN regexp_matches(line, '(?i)^\s*https?://\S+\s*$') THEN 'link' WHEN regexp_matches(line, '(\S+ \| ){2,}') THEN 'nav' WHEN regexp_matches(line, '^\s*[#*=_-]{3,}\s*$') THEN 'marker' END"
GRAMS8 = "(SELECT DISTINCT {k}, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {k}, list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM {t}) WHERE len(w) >= 8))"
TGRAMS = "(SELECT lang, k, min(doc_id) AS id, list_distinct(list_transform(range(1, greatest(2, length(k))), lambda i: substr(k, i, 2))) AS g FROM (SELECT doc_id, lang, regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]', '', 'g') AS k FROM documents) WHERE length(k) >= 1 GROUP BY lang, k)"
SIMILAR = f"SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)), 6) AS score FROM {TGRAMS} x JOIN {TGRAMS} y ON x.lang = y.lang AND x.id < y.id AND len(x.g) * 10 >= len(y.g) * 7 - 1 AND len(y.g) * 10 >= len(x.g) * 7 - 1 WHERE round(len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)), 6) >= 0.7"

SQL = {
    "loose_keys": "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS loose, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand FROM part",
    "identity_keys": f"SELECT doc_id, lower(trim(regexp_replace(trim({TITLE}, ' '), '^《([^\\n]+)》$', '\\1'), ' ')) AS title_key, lower(trim('  ' || source, ' ')) AS author_key FROM documents".replace("\\\\", "\\"),
    "twin_detection": f"SELECT k, count(*) AS spellings FROM (SELECT DISTINCT {TITLE} AS title, regexp_replace(lower({TITLE}), '[^a-z0-9]', '', 'g') AS k FROM documents) WHERE k <> '' GROUP BY 1 HAVING count(*) > 1",
    "author_match_pairs": "SELECT c_custkey, s_suppkey, levenshtein('c' || substr(c_name, 10, 9), 's' || substr(s_name, 10, 9)) AS edits FROM customer JOIN supplier ON substr(c_name, 10, 9) = substr(s_name, 10, 9)",
    "url_host_station": f"SELECT page_id, {HOST} AS host, regexp_replace({HOST}, '^((www|m)[.])+', '') AS station FROM pages",
    "url_normalize": f"SELECT page_id, {NORMAL} AS url FROM pages",
    "url_upgrade_collision": f"SELECT page_id, u FROM (SELECT *, max(native) OVER (PARTITION BY u) AS a FROM (SELECT page_id, regexp_replace({NORMAL}, '^http://', 'https://') AS u, CAST(starts_with(url, 'https://') AS INTEGER) AS native FROM pages)) WHERE native = 1 OR a = 0",
    "backoff_curves": "SELECT event_id, CAST(least(3600, 5 * power(2, event_id % 12)) AS BIGINT) AS wait2, CAST(least(100000, power(4, event_id % 12)) AS BIGINT) AS wait4 FROM events",
    "fail_prefix_codec": "SELECT event_id, CAST(event_id % 5 AS INTEGER) AS fails, 'fail_count:' || (event_id % 5 + 1) || ':x' AS next FROM events",
    "chapter_number": "SELECT o_orderkey, nullif(CAST(trunc(o_totalprice % 10000) AS BIGINT), 0) AS number FROM orders",
    "char_ngrams_topk": f"SELECT gram, count(*) AS n FROM (SELECT DISTINCT doc_id, substr(k, i, 4) AS gram FROM (SELECT doc_id, k, unnest(range(1, length(k) - 2)) AS i FROM (SELECT doc_id, regexp_replace(lower({TITLE}), '[^a-z0-9]', '', 'g') AS k FROM documents) WHERE length(k) >= 4)) GROUP BY 1 ORDER BY n DESC, gram LIMIT 50",
    "similar_titles": SIMILAR,
    "dup_clusters": f"WITH RECURSIVE e AS (SELECT a, b FROM ({SIMILAR}) UNION SELECT b, a FROM ({SIMILAR})), r AS (SELECT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a) SELECT n AS doc_id, min(m) AS cluster FROM r GROUP BY 1",
    "clip_ellipsis": "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 79) || '…' ELSE text END AS head FROM documents",
    "control_squash": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS h FROM documents",
    "genre_rules": "SELECT CASE WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 'warm' WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'cold' ELSE 'other' END AS genre, count(*) AS n FROM part GROUP BY 1",
    "line_drop_rules": f"SELECT doc_id, line_no, reason FROM (SELECT doc_id, line_no, {REASON} AS reason FROM {LINES}) WHERE reason IS NOT NULL",
    "line_dedupe_long": f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS rn FROM {LINES}) WHERE rn = 1 OR length(line) < 20 GROUP BY 1",
    "template_lines": f"SELECT md5(trim(line, ' ')) AS line_hash, count(DISTINCT doc_id) AS docs FROM {LINES} WHERE length(trim(line, ' ')) >= 2 GROUP BY trim(line, ' ') HAVING count(DISTINCT doc_id) >= 2",
    "prepare_verdict": f"SELECT doc_id, chars, kept_chars, CASE WHEN chars = 0 THEN 'empty' WHEN length(text) <= 200 AND regexp_matches(trim(text, ' '), '(…|[.][.][.])$') THEN 'preview' WHEN kept_chars < 0.7 * chars THEN 'noisy' WHEN kept_chars < 500 THEN 'short' ELSE 'ready' END AS verdict FROM documents JOIN (SELECT doc_id, CAST(sum(length(line)) AS INTEGER) AS chars, CAST(coalesce(sum(length(line)) FILTER (WHERE reason IS NULL), 0) AS INTEGER) AS kept_chars FROM (SELECT doc_id, line, {REASON} AS reason FROM {LINES}) GROUP BY 1) USING (doc_id)",
    "mojibake_ratio": "SELECT doc_id, round(coalesce(len(regexp_extract_all(text, '[ÃÂâ€�]')) / nullif(length(text), 0), 0), 6) AS ratio FROM documents",
    "benchmark_contamination": f"SELECT doc_id, item_id, count(*) AS hits FROM {GRAMS8.format(k='doc_id', t='documents')} d JOIN {GRAMS8.format(k='item_id', t='benchmark')} b USING (g) GROUP BY ALL",
    "readability": r"SELECT CASE WHEN length(regexp_replace(text, '[ \t\r\n]', '', 'g')) < 500 THEN 'short' ELSE 'readable' END AS verdict, count(*) AS n FROM documents GROUP BY 1",
    "jsonpath_child": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "template_render": "SELECT event_id, 'https://example.org/' || coalesce(json_extract_string(props, '$.k'), '') || '?x=' AS url FROM events",
    "regex_suffix": "SELECT event_id, regexp_replace(json_extract_string(props, '$.k'), '[0-4]', '*', 'g') AS masked FROM events",
    "or_first_nonblank": "SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS v FROM events",
    "and_merge": "SELECT event_id, json_extract_string(props, '$.k') || chr(10) || json_extract_string(props, '$.k') AS v FROM events",
    "aio_regex_list": """SELECT page_id, i - 1 AS item_no, h[i] AS href, n[i] AS name FROM (SELECT page_id, h, n, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS n FROM pages))""",
    "veto_clauses": r"SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(lower(text), '[.,;!?\n]'), lambda c: contains(c, 'tion') AND NOT contains(c, ' not '))) > 0 THEN 'veto' ELSE 'pass' END AS verdict FROM documents",
    "rerank_top10": "SELECT doc_id, round(2 * quality - 3 * toxic + least(n_chars, 4000) / 4000, 6) AS score FROM documents JOIN labels USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10",
    "lww_state": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "rate_limit_windows": "SELECT event_type, ws AS window_start, attempts, attempts <= 2 AS allowed, CASE WHEN attempts <= 2 THEN 0 ELSE CAST(3600 - (CAST(floor(epoch(l)) AS BIGINT) - ws) AS INTEGER) END AS retry_after_s FROM (SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ws, count(*) AS attempts, max(ts) AS l FROM events GROUP BY 1, 2)",
    "session_gap": "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, sid, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 720 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY 1, 2) GROUP BY 1",
    "stale_reclaim_transition": "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'O' AND o_orderdate < m - INTERVAL 365 DAYS THEN CASE WHEN o_orderkey % 4 >= 3 THEN 'failed' ELSE 'pending' END ELSE o_orderstatus END AS next_status, count(*) AS n FROM orders, (SELECT max(o_orderdate) AS m FROM orders) GROUP BY 1, 2",
    "append_detection": "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'baseline' WHEN conv_id % 5 = 0 THEN 'rebased' WHEN count(*) <= 3 THEN 'unchanged' ELSE 'appended' END AS state FROM conversations GROUP BY conv_id",
    "chapter_split": "SELECT doc_id, len(string_split(text, chr(10))) AS chapters, 0 AS first, strlen(text) + (len(string_split(text, chr(10))) - 1) * (strlen(CAST(doc_id AS VARCHAR)) + 8) AS bytes FROM documents",
    "volume_pack": "WITH RECURSIVE x AS (SELECT source, doc_id, strlen(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents), r AS (SELECT source, doc_id, n, rn, CAST(0 AS BIGINT) AS volume, CAST(0 AS BIGINT) AS volume_offset FROM x WHERE rn = 1 UNION ALL SELECT x.source, x.doc_id, x.n, x.rn, CASE WHEN r.volume_offset + r.n + x.n > 20000 THEN r.volume + 1 ELSE r.volume END, CASE WHEN r.volume_offset + r.n + x.n > 20000 THEN 0 ELSE r.volume_offset + r.n END FROM r JOIN x ON x.source = r.source AND x.rn = r.rn + 1) SELECT source, doc_id, volume, volume_offset FROM r",
    "capacity_running": "SELECT l_suppkey, count(*) AS fit, max(used) AS used FROM (SELECT l_suppkey, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS used FROM lineitem) WHERE used <= 500 GROUP BY 1",
    "snapshot_orphans": "SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= '1998-06-01')",
    "upsert_orders": "SELECT CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 2 = 0 THEN 'X' WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "insert_absent_customers": "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NEW' END AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
    "stream_tumbling": "SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_lww": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "stream_first_of_day": "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events",
    "stream_circuits": "SELECT user_id, event_id FROM (SELECT *, lag(event_type, 1, '') OVER w AS p1, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS k FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE k = 2",
}

QUERIES = {
    f.__name__: f
    for f in (
        identity_keys, loose_keys, twin_detection, author_match_pairs, url_host_station, url_normalize, url_upgrade_collision, backoff_curves, fail_prefix_codec,
        chapter_number, char_ngrams_topk, similar_titles, dup_clusters, clip_ellipsis, control_squash, genre_rules, line_drop_rules, line_dedupe_long,
        template_lines, prepare_verdict, mojibake_ratio, benchmark_contamination, readability, content_html_to_text, css_title, css_links,
        toc_links_last_wins, jsonpath_child, template_render, regex_suffix, or_first_nonblank, and_merge, aio_regex_list, veto_clauses, rerank_top10,
        lww_state, rate_limit_windows, session_gap, stale_reclaim_transition, append_detection, chapter_split, volume_pack, capacity_running,
        snapshot_orphans, upsert_orders, insert_absent_customers, stream_tumbling, stream_lww, stream_first_of_day, stream_circuits,
    )
}
