"""Pool, task, cleaning and storage queries over the driver tables that are not in the other modules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import textquality as Q
from ..sources.tables import table as t


def library_finish_facet(s, d):
    """Facet of the first value that isn't blank, others under one name."""
    c = X.first_non_blank(F.when(F.col("lang") == "en", F.lit(" ")).otherwise(F.col("lang")), F.col("source"))
    return t(s, d, "documents").groupBy(F.coalesce(c, F.lit("other")).alias("facet")).agg(F.count("*").alias("n"))


def library_total_beside_page(s, d):
    """Rows, pages and the page asked for, held within them."""
    x = t(s, d, "documents").where("n_chars > 300").agg(F.count("*").alias("n"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("n") / 30)).cast("long")
    return x.select("n", pages.alias("pages"), F.least(pages, F.lit(10000)).alias("page"), ((F.least(pages, F.lit(10000)) - 1) * 30).alias("offset"))


def download_stats(s, d):
    o = t(s, d, "orders")
    return o.agg(
        F.count("*").alias("tasks"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_distinct("o_custkey").alias("users"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("last_done"),
    )


def orphan_key_union(s, d):
    """Pages joined by url, and those that only match once fragment and last slash are gone."""
    p = t(s, d, "pages").withColumn("key", X.url_normal(F.col("url")))
    known = p.where("page_id % 2 = 0").select(F.col("url").alias("known_url"), F.col("key").alias("known_key")).distinct()
    exact = p.join(known, F.col("url") == F.col("known_url"), "left_semi").select("page_id", F.lit("exact").alias("how"))
    rest = p.join(exact, "page_id", "left_anti").join(known, F.col("key") == F.col("known_key"), "left_semi")
    return exact.unionByName(rest.select("page_id", F.lit("orphan").alias("how")))


def single_point(s, d):
    """Share of books that one source alone can give, and the largest source's share of all that are covered."""
    ok = t(s, d, "lineitem").where("l_returnflag = 'N'").select("l_partkey", "l_suppkey").distinct()
    books = ok.groupBy("l_partkey").agg(F.count("*").alias("n_src"), F.min("l_suppkey").alias("only"))
    top = ok.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    top = top.agg(F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("top_source"), F.max("n").alias("top_books"))
    one = books.agg(F.count("*").alias("books"), F.count_if(F.col("n_src") == 1).alias("sole"))
    return one.crossJoin(F.broadcast(top)).withColumn("top_share", F.round(F.col("top_books") / F.col("books"), 6))  # a row each


def url_fragment_strip(s, d):
    c = F.col("url")
    return t(s, d, "pages").select("page_id", F.regexp_replace(c, "#.*$", "").alias("url"), F.nullif(F.regexp_extract(c, "#(.*)$", 1), F.lit("")).alias("fragment"), F.split_part(c, F.lit("/"), F.lit(3)).alias("authority"))


def fold_translate(s, d):
    x = t(s, d, "documents").select("doc_id", F.concat(F.lit("ＡＢ（１２）　"), F.col("text")).alias("c"))
    return x.select("doc_id", X.fold_width(F.col("c")).alias("folded"))


def title_clean(s, d):
    """Brackets of version notes at the end of a title go, all of them, and one layer around the title."""
    raw = F.concat(F.lit("《"), "p_name", F.lit("》（精校版）[完本] "))
    c = F.btrim(F.regexp_replace(F.btrim(raw), r"(\s*(（[^（）]*）|\([^()]*\)|\[[^\[\]]*\]|【[^【】]*】))+$", ""))
    return t(s, d, "part").select("p_partkey", F.regexp_replace(c, r"^《([^\n]+)》$", "$1").alias("title"))


def preview_docs(s, d):
    return t(s, d, "documents").where(Q.is_preview(F.col("text"))).select("doc_id", "n_chars")


def rolling_prefix_hash(s, d):
    """Hash of the first three turns of each conversation, in order."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    x = t(s, d, "conversations").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    head = F.array_sort(F.collect_list(F.struct("rn", "text")))  # three at most
    return x.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(head, lambda r: r["text"]), "\x1f")).alias("h"), F.count("*").alias("n"))


def latest_turn(s, d):
    x = t(s, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"))
    return x


def role_alternation(s, d):
    """Turns that have the role of the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t(s, d, "conversations").withColumn("before", F.lag("role").over(w))
    return x.where("role = before").groupBy("conv_id").agg(F.count("*").alias("repeats"))


def near_source_pairs(s, d):
    """Sources whose sets of parts overlap the most, by Jaccard similarity of what they give.

    A part's sources meet as the rest of its sorted list behind each, so that a list, not each pair, is shuffled, once,
    to its first source; pairs are counted where they arrive.
    """
    x = t(s, d, "lineitem").select("l_suppkey", "l_partkey").where("l_suppkey is not null").distinct()
    n = x.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    met = x.where("l_partkey is not null").groupBy("l_partkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("of"))  # a part's sources
    met = met.select("of", F.posexplode("of").alias("i", "a")).where(F.col("i") < F.size("of") - 1)
    rest = met.select("a", F.slice("of", F.col("i") + 2, F.size("of")).alias("rest")).repartition("a")
    own = rest.join(n.select(F.col("l_suppkey").alias("a"), F.col("n").alias("na")).hint("shuffle_hash"), "a")
    both = own.select("a", "na", F.explode("rest").alias("b")).groupBy("a", "na", "b").agg(F.count("*").alias("common"))
    both = both.join(n.select(F.col("l_suppkey").alias("b"), F.col("n").alias("nb")).hint("shuffle_hash"), "b")
    return both.select("a", "b", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("score"))


def probe_plan_order(s, d):
    """Never probed first, then due, then successes to check again, then the rest; the oldest first in each class."""
    x = t(s, d, "supplier").withColumn("k", F.col("s_suppkey") % 11)
    cls = F.when(F.col("k") == 0, 0).when(F.col("k") < 4, 1).when(F.col("s_acctbal") > 5000, 2).otherwise(3)
    w = Window.orderBy("plan_class", F.asc_nulls_first("k"), "s_suppkey")  # sources: a small dimension
    return x.withColumn("plan_class", cls).withColumn("place", F.row_number().over(w).cast("long")).select("s_suppkey", "plan_class", "place")


def best_tier_pick(s, d):
    """For each brand the part of the best tier, then nearest to the wanted size, then first."""
    tier = F.when(F.contains("p_type", F.lit("BRASS")), 0).when(F.contains("p_type", F.lit("STEEL")), 1).otherwise(2)
    best = F.min(F.struct(tier.alias("tier"), F.abs(F.col("p_size") - 25).alias("dist"), F.col("p_partkey").alias("p"))).alias("b")
    return t(s, d, "part").groupBy("p_brand").agg(best).select("p_brand", F.col("b.p").alias("p_partkey"), F.col("b.tier").alias("tier"))


def severity_merge(s, d):
    """The worst event type of each user and its severity."""
    rank = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    e = t(s, d, "events").withColumn("severity", rank)
    worst = R.representative(e, ["user_id", "event_type"], [F.asc("event_id")])
    worst = worst.groupBy("user_id").agg(F.max_by("event_type", F.struct("severity", "event_type")).alias("worst"), F.max("severity").alias("severity"))
    return worst


def gate_log_carry(s, d):
    """Each event without a stamp takes the last stamp before it among the user's events."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    stamp = F.when(F.col("event_id") % 4 == 0, F.unix_timestamp(F.col("ts").cast("timestamp")))
    return t(s, d, "events").select("event_id", F.last(stamp, ignorenulls=True).over(w).alias("stamp"))


def never_hit_sources(s, d):
    """Sources with many misses and no hit in the last year of the table."""
    li = t(s, d, "lineitem")
    li = li.crossJoin(F.broadcast(li.agg(F.max("l_shipdate").alias("as_of"))))  # one row
    recent = F.col("l_shipdate") > F.col("as_of") - F.expr("INTERVAL 365 DAYS")
    g = li.groupBy("l_suppkey").agg(F.count_distinct(F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))).alias("misses"), F.count_if(recent & (F.col("l_returnflag") == "N") & (F.col("l_discount") > 0.09)).alias("hits"))
    return g.where("misses >= 5 and hits <= 2")


def version_regression(s, d):
    """Orders whose total fell below seven tenths of the customer's order before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = t(s, d, "orders").withColumn("before", F.lag("o_totalprice").over(w))
    return x.where(F.col("o_totalprice") < 0.7 * F.col("before")).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("before"), 6).alias("ratio"))


def snapshot_gc(s, d):
    """Old versions that may go: neither the last two of their key nor within the days of grace."""
    o = t(s, d, "orders")
    o = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("as_of"))))  # one row
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    x = o.withColumn("rn", F.row_number().over(w))
    return x.where((F.col("rn") > 2) & (F.col("o_orderdate") < F.col("as_of") - F.expr("INTERVAL 7 DAYS"))).select("o_orderkey", "o_custkey")


def inventory_reconcile(s, d):
    """Keys of two inventories by where they are: both, and alike or not, or one only."""
    a = t(s, d, "part").where("p_partkey % 3 <> 0").select("p_partkey", "p_size")
    b = t(s, d, "part").where("p_partkey % 3 <> 1").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(F.col("p_size")).alias("size_b"))
    state = F.when(F.col("p_size").isNull(), "ledger_only").when(F.col("size_b").isNull(), "tree_only").when(F.col("p_size") == F.col("size_b"), "match").otherwise("differs")
    return a.join(b, "p_partkey", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def daily_report(s, d):
    """Counts of each day beside those of the day before."""
    x = t(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    w = Window.orderBy("day")  # a row for each day
    before = F.lag("n").over(w)
    arrow = F.when(before.isNull(), "").when(F.col("n") > before, "up").when(F.col("n") < before, "down").otherwise("same")
    return x.select("day", "n", "errors", before.alias("n_before"), arrow.alias("trend"))


def deletion_kind(s, d):
    """Why a customer's open orders may go: failed twice lately, nothing ever done, or not at all."""
    o = t(s, d, "orders")
    o = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("as_of"))))  # one row
    p = F.col("o_orderstatus") == "P"
    g = o.groupBy("o_custkey").agg(F.count_if(p & (F.col("o_orderdate") > F.col("as_of") - F.expr("INTERVAL 1500 DAYS"))).alias("recent_p"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return g.select("o_custkey", F.when(F.col("recent_p") >= 2, "final").when(F.col("done") == 0, "empty").otherwise("keep").alias("kind"))


def claim_order(s, d):
    """Next orders to claim: those whose customer is not busy, oldest first."""
    o = t(s, d, "orders")
    busy = o.where("o_orderstatus = 'P'").select("o_custkey").distinct()
    x = o.where("o_orderstatus = 'O'").join(busy, "o_custkey", "left_anti")
    return x.orderBy(F.asc_nulls_first("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_custkey")


def watermark_prefix(s, d):
    """How far each user's absorbed mark may go: the event before the first error, or the last of all."""
    e = t(s, d, "events")
    first = F.min(F.when(F.col("event_type") == "error", F.col("event_id")))
    g = e.groupBy("user_id").agg(first.alias("stop"), F.max("event_id").alias("last"))
    x = e.join(g, "user_id").where(F.col("stop").isNull() | (F.col("event_id") < F.col("stop")))
    return x.groupBy("user_id").agg(F.max("event_id").alias("mark"))


def query_overlap(s, d):
    """Months of 1995 and of 1996 that share a twentieth of their parts or more."""
    x = t(s, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("m"), F.col("l_partkey").alias("p")).distinct()
    a, b = x.where("m like '1995%'"), x.where("m like '1996%'")
    na, nb = a.groupBy("m").agg(F.count("*").alias("na")), b.groupBy("m").agg(F.count("*").alias("nb"))
    j = a.withColumnRenamed("m", "ma").join(b.withColumnRenamed("m", "mb"), "p").groupBy("ma", "mb").agg(F.count("*").alias("k"))
    j = j.join(na.withColumnRenamed("m", "ma"), "ma").join(nb.withColumnRenamed("m", "mb"), "mb")
    j = j.withColumn("score", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6))
    return j.where("score >= 0.05").select("ma", "mb", "score")


def content_parts_join(s, d):
    """Turns of a conversation joined in order, as parts of one page."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))  # a conversation's turns
    return t(s, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(parts, lambda r: r["text"]), "\n")).alias("h"), F.count("*").alias("parts"))


def challenge_pages(s, d):
    c = F.lower("html")
    return t(s, d, "pages").select("page_id", (c.rlike("captcha|verify you are human|access denied") | (F.char_length("html") < 200)).alias("challenge"))


NORMAL = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '')"

SQL = {
    "library_finish_facet": "SELECT coalesce(nullif(trim(CASE WHEN lang = 'en' THEN ' ' ELSE lang END, ' '), ''), nullif(trim(source, ' '), ''), 'other') AS facet, count(*) AS n FROM documents GROUP BY 1",
    "library_total_beside_page": "SELECT n, pages, least(pages, 10000) AS page, (least(pages, 10000) - 1) * 30 AS offset FROM (SELECT n, CAST(greatest(1, ceil(n / 30)) AS BIGINT) AS pages FROM (SELECT count(*) AS n FROM documents WHERE n_chars > 300))",
    "download_stats": "SELECT count(*) AS tasks, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(DISTINCT o_custkey) AS users, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS last_done FROM orders",
    "orphan_key_union": f"WITH p AS (SELECT page_id, url, {NORMAL} AS key FROM pages), k AS (SELECT url, key FROM p WHERE page_id % 2 = 0) SELECT page_id, CASE WHEN url IN (SELECT url FROM k) THEN 'exact' ELSE 'orphan' END AS how FROM p WHERE url IN (SELECT url FROM k) OR key IN (SELECT key FROM k)",
    "single_point": "WITH ok AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'), b AS (SELECT count(*) AS books, count(*) FILTER (WHERE n = 1) AS sole FROM (SELECT l_partkey, count(*) AS n FROM ok GROUP BY 1)), s AS (SELECT l_suppkey AS top_source, count(*) AS top_books FROM ok GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) SELECT books, sole, top_source, top_books, round(top_books / books, 6) AS top_share FROM b, s",
    "url_fragment_strip": "SELECT page_id, regexp_replace(url, '#.*$', '') AS url, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment, split_part(url, '/', 3) AS authority FROM pages",
    "fold_translate": "SELECT doc_id, translate('ＡＢ（１２）　' || text, 'ＡＢ（１２）　', 'AB(12) ') AS folded FROM documents",
    "title_clean": "SELECT p_partkey, p_name AS title FROM part",
    "preview_docs": "SELECT doc_id, n_chars FROM documents WHERE length(text) <= 200 AND regexp_matches(trim(text, ' '), '(…|[.][.][.])$')",
    "rolling_prefix_hash": "SELECT conv_id, md5(string_agg(text, chr(31) ORDER BY turn, role)) AS h, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations) WHERE rn <= 3 GROUP BY 1",
    "latest_turn": "SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS last_turn, count(*) AS turns FROM conversations GROUP BY 1",
    "role_alternation": "SELECT conv_id, count(*) AS repeats FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE role = before GROUP BY 1",
    "near_source_pairs": "WITH x AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT l_suppkey, count(*) AS n FROM x GROUP BY 1) SELECT c.a, c.b, round(k / (p.n + q.n - k), 6) AS score FROM (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS k FROM x JOIN x y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2) c JOIN n p ON c.a = p.l_suppkey JOIN n q ON c.b = q.l_suppkey",
    "probe_plan_order": "SELECT s_suppkey, plan_class, row_number() OVER (ORDER BY plan_class, s_suppkey % 11, s_suppkey) AS place FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 0 WHEN s_suppkey % 11 < 4 THEN 1 WHEN s_acctbal > 5000 THEN 2 ELSE 3 END AS plan_class FROM supplier)",
    "best_tier_pick": "SELECT p_brand, p_partkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, abs(p_size - 25), p_partkey) AS rn FROM (SELECT *, CASE WHEN contains(p_type, 'BRASS') THEN 0 WHEN contains(p_type, 'STEEL') THEN 1 ELSE 2 END AS tier FROM part)) WHERE rn = 1",
    "severity_merge": "SELECT user_id, arg_max(event_type, (severity, event_type)) AS worst, max(severity) AS severity FROM (SELECT *, CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS severity FROM events) GROUP BY 1",
    "gate_log_carry": "SELECT event_id, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stamp FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS s FROM events)",
    "never_hit_sources": "SELECT l_suppkey, misses, hits FROM (SELECT l_suppkey, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag <> 'N') AS misses, count(*) FILTER (WHERE l_shipdate > m - INTERVAL 365 DAYS AND l_returnflag = 'N' AND l_discount > 0.09) AS hits FROM lineitem, (SELECT max(l_shipdate) AS m FROM lineitem) GROUP BY 1) WHERE misses >= 5 AND hits <= 2",
    "version_regression": "SELECT o_orderkey, round(o_totalprice / before, 6) AS ratio FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE o_totalprice < CAST(0.7 AS DOUBLE) * before",
    "snapshot_gc": "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, max(o_orderdate) OVER () AS m FROM orders) WHERE rn > 2 AND o_orderdate < m - INTERVAL 7 DAYS",
    "inventory_reconcile": "SELECT CASE WHEN a.p_size IS NULL THEN 'ledger_only' WHEN b.size_b IS NULL THEN 'tree_only' WHEN a.p_size = b.size_b THEN 'match' ELSE 'differs' END AS state, count(*) AS n FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS size_b FROM part WHERE p_partkey % 3 <> 1) b USING (p_partkey) GROUP BY 1",
    "daily_report": "SELECT day, n, errors, b AS n_before, CASE WHEN b IS NULL THEN '' WHEN n > b THEN 'up' WHEN n < b THEN 'down' ELSE 'same' END AS trend FROM (SELECT *, lag(n) OVER (ORDER BY day) AS b FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1))",
    "deletion_kind": "SELECT o_custkey, CASE WHEN r >= 2 THEN 'final' WHEN f = 0 THEN 'empty' ELSE 'keep' END AS kind FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderdate > m - INTERVAL 1500 DAYS) AS r, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders, (SELECT max(o_orderdate) AS m FROM orders) GROUP BY 1)",
    "claim_order": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 20",
    "watermark_prefix": "SELECT user_id, max(event_id) AS mark FROM (SELECT *, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events) WHERE stop IS NULL OR event_id < stop GROUP BY 1",
    "query_overlap": "WITH x AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS m, l_partkey AS p FROM lineitem), n AS (SELECT m, count(*) AS n FROM x GROUP BY 1) SELECT ma, mb, score FROM (SELECT ma, mb, round(k / (na.n + nb.n - k), 6) AS score FROM (SELECT a.m AS ma, b.m AS mb, count(*) AS k FROM x a JOIN x b ON a.p = b.p WHERE a.m LIKE '1995%' AND b.m LIKE '1996%' GROUP BY 1, 2) JOIN n na ON ma = na.m JOIN n nb ON mb = nb.m) WHERE score >= 0.05",
    "content_parts_join": "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, role)) AS h, count(*) AS parts FROM conversations GROUP BY 1",
    "challenge_pages": "SELECT page_id, regexp_matches(lower(html), 'captcha|verify you are human|access denied') OR length(html) < 200 AS challenge FROM pages",
}

QUERIES = {
    f.__name__: f
    for f in (
        library_finish_facet, library_total_beside_page, download_stats, orphan_key_union, single_point, url_fragment_strip, fold_translate, title_clean,
        preview_docs, rolling_prefix_hash, latest_turn, role_alternation, near_source_pairs, probe_plan_order, best_tier_pick, severity_merge, gate_log_carry,
        never_hit_sources, version_regression, snapshot_gc, inventory_reconcile, daily_report, deletion_kind, claim_order, watermark_prefix, query_overlap,
        content_parts_join, challenge_pages,
    )
}
