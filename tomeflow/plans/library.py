"""Library, shelf, search and usage queries over the driver tables (documents stand for books)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..sources.tables import table as t


def _rated(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").join(t(s, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


RATED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
PAGE_ORDER = lambda: [F.col("quality").desc_nulls_last(), F.desc("n_chars"), F.desc("doc_id")]


def library_totals(s, d):
    return _rated(s, d).agg(
        F.count("*").alias("books"), F.count("quality").alias("rated"), F.round(F.avg("quality"), 3).alias("avg_quality"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.max("n_chars").alias("longest"),
    )


def library_facets_top12(s, d):
    return R.facet(t(s, d, "documents"), "source", "facet", 12)


def library_lang_quality(s, d):
    x = _rated(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNull()).alias("unrated"))
    return x.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def library_page_quality(s, d):
    return R.page(_rated(s, d), PAGE_ORDER(), 2, 30).select("doc_id", "quality", "n_chars")


def library_page_title(s, d):
    x = t(s, d, "documents").withColumn("title", X.clip(F.split("text", "\n")[0], 40))
    return R.page(x, [F.asc_nulls_first("title"), F.asc("doc_id")], 3, 30).select("doc_id", "title")


def library_page_late_mat(s, d):
    return R.page_late(_rated(s, d), "doc_id", PAGE_ORDER(), 4, 30).select("doc_id", "lang", "source", F.substring("text", 1, 60).alias("head"))


def library_search_escaped(s, d):
    """Texts that hold a user's % or _ as such: the wildcards of what was typed are escaped in the pattern."""
    c = F.lower("text")
    hits = R.where_all(t(s, d, "documents"), [c.like(r"%\%%") | c.like(r"%\_%"), None])
    return hits.select("doc_id", "n_chars", F.length(X.escape_like(F.col("text"))).alias("escaped_chars"))


def library_tag_or_filter(s, d):
    return R.where_all(t(s, d, "documents"), [F.col("lang").isin("en", "de"), F.col("source").isin("src1", "src2") | (F.col("n_chars") > 5000)]).select("doc_id", "lang", "source")


def library_usable_semi(s, d):
    return t(s, d, "documents").join(t(s, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


def no_active_task_anti(s, d):
    open_ = t(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return t(s, d, "customer").join(open_, "c_custkey", "left_anti").select("c_custkey", "c_name")


def _shelf(s, d):
    x = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = [F.desc("l_shipdate"), F.desc("l_extendedprice"), F.desc("l_orderkey"), F.desc("l_linenumber")]
    return R.representative(x, ["o_custkey", "l_partkey"], order)


SHELF = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate DESC, l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) rn
FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1)"""


def shelf_latest_per_book(s, d):
    return _shelf(s, d).select("o_custkey", "l_partkey", "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))


def shelf_status_counts(s, d):
    return _shelf(s, d).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def shelf_page_300(s, d):
    x = _shelf(s, d).where("o_custkey = 7")
    return x.orderBy(F.desc("l_shipdate"), "l_partkey").limit(300).select("l_partkey", "l_orderkey", "l_linenumber")


def shelf_read_task_join(s, d):
    last = t(s, d, "orders").groupBy("o_custkey").agg(
        F.max("o_orderkey").alias("last_order"), F.max_by("o_orderpriority", "o_orderkey").alias("last_priority"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("last_done"),
    )
    return t(s, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_order", "last_priority", "last_done")


def shelf_has_update(s, d):
    per = t(s, d, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("read_at"))
    x = t(s, d, "orders").join(per, "o_custkey", "left")
    return x.groupBy("o_custkey").agg(F.bool_or(F.col("read_at").isNull() | (F.col("o_orderdate") > F.col("read_at"))).alias("has_update"))


def exact_hits_union(s, d):
    q = F.lit("steel")
    a = t(s, d, "part").where(F.contains(F.lower("p_name"), q) | (F.col("p_size") == 7)).select(F.lower("p_name").alias("name"), F.lit(0).alias("rank"), F.col("p_partkey").alias("id"))
    b = t(s, d, "supplier").select(F.lower("s_name").alias("name"), F.lit(1).alias("rank"), F.col("s_suppkey").alias("id"))
    b = b.join(a, "name", "left_anti")
    return a.unionByName(b).orderBy("rank", "id").limit(25)


def excluded_books_or_exists(s, d):
    p, li = t(s, d, "part"), t(s, d, "lineitem")
    dear = li.where("l_discount > 0.09 and l_quantity > 48").select("l_partkey")
    returned = li.where("l_returnflag = 'R' and l_quantity < 2").select("l_partkey")
    either = dear.union(returned).distinct()
    return p.join(either, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


def find_stats(s, d):
    e = t(s, d, "events")
    return e.agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 3).alias("spent"),
        F.round(F.avg(F.when(F.col("event_type") == "error", F.col("value"))), 3).alias("avg_error"),
    )


def _as_of(e: DataFrame):
    return e.agg(F.max("ts").alias("as_of"))


def usage_dual_window(s, d):
    e = t(s, d, "events")
    e = e.crossJoin(F.broadcast(_as_of(e)))  # one row
    return R.dual_window(e, ["event_type"], "ts", "value", F.col("as_of"), 24)


def usage_grand_total(s, d):
    e = t(s, d, "events")
    r = e.rollup("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.grouping("event_type").cast("int").alias("is_total"))
    return r.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), "n", "users", "is_total")


def task_observation_pivot(s, d):
    x = t(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    x = x.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in ("F", "O", "P")])
    n = F.col("n_f") + F.col("n_o") + F.col("n_p")
    return x.withColumn("share", F.round(n / F.sum(n).over(Window.partitionBy()), 6))


def task_state_case(s, d):
    o = t(s, d, "orders")
    o = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("as_of"))))
    stale = F.col("o_orderdate") < F.col("as_of") - F.expr("INTERVAL 365 DAYS")
    state = F.when((F.col("o_orderstatus") == "O") & stale, "leaseExpired").when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "partial").otherwise("done")
    return o.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def bucket_counts(s, d):
    b = F.when(F.col("s_acctbal").isNull(), "null").when(F.col("s_acctbal") < 0, "rejected").when(F.col("s_acctbal") < 3000, "recheck").when(F.startswith("s_name", F.lit("Supplier#00000000")), "builtin").otherwise("ok")
    return t(s, d, "supplier").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance")).withColumn("line", F.concat_ws("|", "bucket", F.col("n").cast("string")))


def age_windows(s, d):
    e = t(s, d, "events")
    e = e.crossJoin(F.broadcast(_as_of(e)))
    return e.agg(*[F.count_if(F.col("ts") > F.col("as_of") - F.expr(f"INTERVAL {h} HOURS")).alias(f"w_{h}h") for h in (1, 4, 20, 48, 168)])


def admission_funnel(s, d):
    c = F.col
    return t(s, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(c("value") >= 50).alias("ok"), F.count_if((c("value") < 50) & (c("value") >= 10)).alias("deferred"),
        F.count_if(c("value") < 10).alias("rejected"), F.count_if(F.get_json_object("props", "$.k").isNull()).alias("miss_k"),
    )


def rejection_codes_explode(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    x = t(s, d, "events").where("event_type = 'error'").groupBy((F.floor(k / 10) * 10).cast("int").alias("code")).agg(F.count("*").alias("n"))
    x = x.where("code is not null").select(F.concat(F.col("code").cast("string"), F.lit("="), F.col("n").cast("string")).alias("e"), "code")
    return x.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "e"))), lambda r: r["e"]), ",").alias("codes"))


def productive_scores(s, d):
    o = t(s, d, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg((2 * F.count("*")).alias("n"))
    return a.unionByName(b).groupBy("o_custkey").agg(F.sum("n").alias("score"))


def zero_yield_having(s, d):
    e = t(s, d, "events")
    bad = e.where("event_type = 'error'").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.max("event_id").alias("last_id")).where("days >= 2")
    return bad.join(e.where("event_type = 'purchase' and value > 80").select("user_id").distinct(), "user_id", "left_anti")


def recent_union(s, d):
    e = t(s, d, "events")
    a, b = e.where("event_type = 'signup'").select("user_id"), e.where("value > 95").select("user_id")
    return a.union(b).distinct()


def requeue_candidates(s, d):
    e = t(s, d, "events")
    last = R.representative(e, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.where("event_type in ('error', 'view')").select("user_id", "event_id", "event_type")


def requeue_by_reason(s, d):
    last = requeue_candidates(s, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return last.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "event_type", "n"))), lambda r: F.concat(r["event_type"], F.lit(":"), r["n"].cast("string"))), ";").alias("reasons"))


def _month(s, d, y, m):
    return t(s, d, "lineitem").where((F.year("l_shipdate") == y) & (F.month("l_shipdate") == m)).select("l_partkey", "l_suppkey")


def seeds_except_all_added(s, d):
    x = R.multiset_except(_month(s, d, 1997, 2), _month(s, d, 1997, 1))
    return x.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


def seeds_except_all_removed(s, d):
    x = R.multiset_except(_month(s, d, 1997, 1), _month(s, d, 1997, 2))
    return x.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


def full_outer_drift(s, d):
    o = t(s, d, "orders")
    a = o.where("year(o_orderdate) = 1995").groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = o.where("year(o_orderdate) = 1996").groupBy("o_custkey").agg(F.count("*").alias("n"))
    from ..sources.sinks import drift

    return drift(a, b, ["o_custkey"])


def lateral_top1_best_source(s, d):
    n, sup = t(s, d, "nation"), t(s, d, "supplier")
    best = R.representative(sup, ["s_nationkey"], [F.desc_nulls_last("s_acctbal"), F.asc("s_suppkey")])
    exact = n.join(best, F.col("n_nationkey") == F.col("s_nationkey")).select("n_nationkey", "s_suppkey", F.lit(1).alias("is_exact"))
    region = n.join(sup, F.col("n_nationkey") == F.col("s_nationkey")).select("n_regionkey", "s_suppkey", "s_acctbal")
    region = R.representative(region, ["n_regionkey"], [F.desc_nulls_last("s_acctbal"), F.asc("s_suppkey")])
    rest = n.join(exact, "n_nationkey", "left_anti").join(region, "n_regionkey").select("n_nationkey", "s_suppkey", F.lit(0).alias("is_exact"))
    return exact.unionByName(rest)


def dense_rank_identity(s, d):
    """Identity numbers by rank of distinct names: the small distinct list is ranked, rows join to it."""
    p = t(s, d, "part").withColumn("k", X.identity_title(F.col("p_brand")))
    ids = p.select("k").distinct().withColumn("identity", F.dense_rank().over(Window.orderBy("k")))
    return p.join(ids, "k").select("p_partkey", "identity")


def row_number_prefetch(s, d):
    x = R.representative(t(s, d, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")])
    return x.select("o_custkey", "o_orderkey")


def version_wins_fold(s, d):
    e = t(s, d, "events").withColumn("stamp", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.floor("value").cast("long")))
    return R.version_wins(e, "user_id", "stamp", "event_id", "event_type")


def first_occurrence(s, d):
    x = R.representative(t(s, d, "documents").withColumn("h", F.md5("text")), ["h"], [F.asc("doc_id")])
    return x.select("h", "doc_id")


def last_occurrence(s, d):
    return R.representative(t(s, d, "pages").withColumn("u", X.url_normal(F.col("url"))), ["u"], [F.desc("page_id")]).select("u", "page_id")


def nearest_rank_percentile(s, d):
    x = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return R.nearest_rank(x, ["c_mktsegment"], "o_totalprice", {"p50": 0.5, "p95": 0.95})


def upper_median_query(s, d):
    return R.upper_median(t(s, d, "documents"), ["source"], "n_chars", "median_chars")


def coverage_summary(s, d):
    ok = F.col("l_returnflag") == "N"
    x = t(s, d, "lineitem").groupBy("l_partkey").agg(F.count_if(ok).alias("n_ok"), F.count_distinct(F.when(ok, F.col("l_suppkey"))).alias("n_src"))
    return x.agg(F.count("*").alias("books"), F.count_if(F.col("n_ok") > 0).alias("covered"), F.round(F.avg((F.col("n_ok") > 0).cast("int")), 6).alias("rate"), F.count_if(F.col("n_src") == 1).alias("single_source"))


def source_stats(s, d):
    ok = F.col("l_returnflag") == "N"
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("attempts"), F.count_if(ok).alias("ok"), F.count_distinct(F.when(ok, F.col("l_partkey"))).alias("coverage"), F.round(F.avg("l_quantity"), 4).alias("avg_q"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"), F.count_if(F.col("l_returnflag") == "A").alias("n_a"),
    )


def host_concentration(s, d):
    x = t(s, d, "pages").groupBy(X.url_station(F.col("url")).alias("station")).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).orderBy(F.desc("n"), F.asc_nulls_last("station")).limit(5)


def pool_total_order(s, d):
    x = t(s, d, "supplier").withColumn("tier", (F.col("s_suppkey") % 3).cast("int"))
    order = [F.desc(F.startswith("s_name", F.lit("Supplier#000000001"))), F.asc("tier"), F.desc_nulls_last("s_acctbal"), F.asc("s_suppkey")]
    return x.orderBy(*order).limit(40).select("s_suppkey", "tier")


def first_per_host_24(s, d):
    x = t(s, d, "pages").withColumn("station", X.url_station(F.col("url")))
    return R.representative(x, ["station"], [F.asc("page_id")]).orderBy("page_id").limit(24).select("station", "page_id")


def scan_rotation(s, d):
    n = t(s, d, "nation")
    return R.rotate(n, [F.asc("n_nationkey")], 4, 3, 5, 25).select("n_nationkey", "slot")


def busy_flag_order(s, d):
    o = t(s, d, "orders")
    busy = o.where("o_orderstatus = 'P'").select("o_custkey").distinct().withColumn("busy", F.lit(True))
    x = o.where("o_orderstatus = 'O'").join(busy, "o_custkey", "left").withColumn("busy", F.coalesce("busy", F.lit(False)))
    return x.orderBy("busy", F.asc_nulls_first("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "busy")


def due_followups(s, d):
    o = t(s, d, "orders")
    o = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("as_of"))))
    n = F.col("o_orderkey") % 7
    wait = X.backoff(n, 1, 60)
    x = o.where("o_orderstatus = 'O'").withColumn("wait_days", wait)
    x = x.where(F.datediff("as_of", "o_orderdate") >= F.col("wait_days"))
    return x.orderBy(F.asc_nulls_first("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "wait_days")


def budget_fold_query(s, d):
    li = t(s, d, "lineitem").withColumn("size", F.col("l_quantity").cast("long"))
    return R.budget_fold(li, "l_orderkey", "l_linenumber", "size", 60)


def station_contagion(s, d):
    x = t(s, d, "pages").withColumn("station", X.url_station(F.col("url"))).withColumn("bad", F.contains("html", F.lit("class=\"ad\"")).cast("int"))
    return x.withColumn("any_bad", F.max("bad").over(Window.partitionBy("station"))).where("any_bad = 0").select("page_id", "station")


SQL = {
    "library_totals": f"SELECT count(*) AS books, count(quality) AS rated, round(avg(quality), 3) AS avg_quality, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, max(n_chars) AS longest FROM {RATED}",
    "library_facets_top12": "SELECT source AS facet, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, facet LIMIT 12",
    "library_lang_quality": f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality IS NULL) AS unrated, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {RATED} GROUP BY lang",
    "library_page_quality": f"SELECT doc_id, quality, n_chars FROM {RATED} ORDER BY quality DESC NULLS LAST, n_chars DESC, doc_id DESC LIMIT 30 OFFSET 30",
    "library_page_title": "SELECT doc_id, CASE WHEN length(f) > 40 THEN substr(f, 1, 39) || '…' ELSE f END AS title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS f FROM documents) ORDER BY title NULLS FIRST, doc_id LIMIT 30 OFFSET 60",
    "library_page_late_mat": f"SELECT doc_id, lang, source, substr(text, 1, 60) AS head FROM {RATED} ORDER BY quality DESC NULLS LAST, n_chars DESC, doc_id DESC LIMIT 30 OFFSET 90",
    "library_search_escaped": r"SELECT doc_id, n_chars, length(regexp_replace(text, '([\\%_])', '\\\1', 'g')) AS escaped_chars FROM documents WHERE lower(text) LIKE '%\%%' ESCAPE '\' OR lower(text) LIKE '%\_%' ESCAPE '\'",
    "library_tag_or_filter": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND (source IN ('src1', 'src2') OR n_chars > 5000)",
    "library_usable_semi": "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)",
    "no_active_task_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "shelf_latest_per_book": f"SELECT o_custkey, l_partkey, l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM {SHELF}",
    "shelf_status_counts": f"SELECT o_orderstatus, count(*) AS n FROM {SHELF} GROUP BY 1",
    "shelf_page_300": f"SELECT l_partkey, l_orderkey, l_linenumber FROM {SHELF} WHERE o_custkey = 7 ORDER BY l_shipdate DESC, l_partkey LIMIT 300",
    "shelf_read_task_join": "SELECT c_custkey, last_order, last_priority, last_done FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order, arg_max(o_orderpriority, o_orderkey) AS last_priority, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS last_done FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "shelf_has_update": "SELECT o_custkey, bool_or(read_at IS NULL OR o_orderdate > read_at) AS has_update FROM orders JOIN (SELECT o_custkey AS k, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS read_at FROM orders GROUP BY 1) ON o_custkey = k GROUP BY 1",
    "exact_hits_union": "WITH a AS (SELECT lower(p_name) AS name, 0 AS rank, p_partkey AS id FROM part WHERE contains(lower(p_name), 'steel') OR p_size = 7), b AS (SELECT lower(s_name) AS name, 1 AS rank, s_suppkey AS id FROM supplier WHERE lower(s_name) NOT IN (SELECT name FROM a)) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY rank, id LIMIT 25",
    "excluded_books_or_exists": "SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09 AND l_quantity > 48) OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity < 2)",
    "find_stats": "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(sum(value) FILTER (WHERE event_type = 'purchase'), 3) AS spent, round(avg(value) FILTER (WHERE event_type = 'error'), 3) AS avg_error FROM events",
    "usage_dual_window": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (WHERE ts > m - INTERVAL 24 HOURS) AS n_recent, round(coalesce(sum(value) FILTER (WHERE ts > m - INTERVAL 24 HOURS), 0), 4) AS total_recent FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1",
    "usage_grand_total": "SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(grouping(event_type) AS INTEGER) AS is_total FROM events GROUP BY ROLLUP (event_type)",
    "task_observation_pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1",
    "task_state_case": "SELECT CASE WHEN o_orderstatus = 'O' AND o_orderdate < m - INTERVAL 365 DAYS THEN 'leaseExpired' WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'done' END AS state, count(*) AS n FROM orders, (SELECT max(o_orderdate) AS m FROM orders) GROUP BY 1",
    "bucket_counts": "SELECT bucket, n, balance, bucket || '|' || n AS line FROM (SELECT CASE WHEN s_acctbal IS NULL THEN 'null' WHEN s_acctbal < 0 THEN 'rejected' WHEN s_acctbal < 3000 THEN 'recheck' WHEN starts_with(s_name, 'Supplier#00000000') THEN 'builtin' ELSE 'ok' END AS bucket, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1)",
    "age_windows": "SELECT " + ", ".join(f"count(*) FILTER (WHERE ts > m - INTERVAL {h} HOURS) AS w_{h}h" for h in (1, 4, 20, 48, 168)) + " FROM events, (SELECT max(ts) AS m FROM events)",
    "admission_funnel": "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS ok, count(*) FILTER (WHERE value < 50 AND value >= 10) AS deferred, count(*) FILTER (WHERE value < 10) AS rejected, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS miss_k FROM events GROUP BY 1",
    "rejection_codes_explode": "SELECT string_agg(code || '=' || n, ',' ORDER BY code) AS codes FROM (SELECT CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 10) * 10 AS INTEGER) AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) WHERE code IS NOT NULL",
    "productive_scores": "SELECT o_custkey, CAST(sum(n) AS BIGINT) AS score FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, 2 * count(*) FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) GROUP BY 1",
    "zero_yield_having": "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days, max(event_id) AS last_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80) GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) >= 2",
    "recent_union": "SELECT user_id FROM events WHERE event_type = 'signup' UNION SELECT user_id FROM events WHERE value > 95",
    "requeue_candidates": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1 AND event_type IN ('error', 'view')",
    "requeue_by_reason": "SELECT string_agg(event_type || ':' || n, ';' ORDER BY n DESC, event_type) AS reasons FROM (SELECT event_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1 AND event_type IN ('error', 'view') GROUP BY 1)",
    "seeds_except_all_added": "SELECT l_partkey, l_suppkey, count(*) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate) = 1997 AND month(l_shipdate) = 2 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate) = 1997 AND month(l_shipdate) = 1) GROUP BY ALL",
    "seeds_except_all_removed": "SELECT l_partkey, l_suppkey, count(*) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate) = 1997 AND month(l_shipdate) = 1 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE year(l_shipdate) = 1997 AND month(l_shipdate) = 2) GROUP BY ALL",
    "full_outer_drift": "SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'differs' END AS side FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.n <> b.n",
    "lateral_top1_best_source": "SELECT n_nationkey, c.s_suppkey, c.is_exact FROM nation n, LATERAL (SELECT s_suppkey, is_exact FROM (SELECT s_suppkey, s_acctbal, 1 AS is_exact FROM supplier WHERE s_nationkey = n.n_nationkey UNION ALL SELECT s_suppkey, s_acctbal, 0 FROM supplier JOIN nation m ON s_nationkey = m.n_nationkey WHERE m.n_regionkey = n.n_regionkey) ORDER BY is_exact DESC, s_acctbal DESC NULLS LAST, s_suppkey LIMIT 1) c",
    "dense_rank_identity": "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY lower(trim(p_brand))) AS INTEGER) AS identity FROM part",
    "row_number_prefetch": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn FROM orders) WHERE rn = 1",
    "first_occurrence": "SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "last_occurrence": "SELECT regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '') AS u, max(page_id) AS page_id FROM pages GROUP BY 1",
    "nearest_rank_percentile": "SELECT c_mktsegment, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "upper_median": "SELECT source, list_sort(list(n_chars))[CAST(floor(count(n_chars) / 2) AS BIGINT) + 1] AS median_chars FROM documents GROUP BY 1",
    "coverage_summary": "SELECT count(*) AS books, count(*) FILTER (WHERE n_ok > 0) AS covered, round(avg(CAST(n_ok > 0 AS INTEGER)), 6) AS rate, count(*) FILTER (WHERE n_src = 1) AS single_source FROM (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'N') AS n_ok, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'N') AS n_src FROM lineitem GROUP BY 1)",
    "source_stats": "SELECT l_suppkey, count(*) AS attempts, count(*) FILTER (WHERE l_returnflag = 'N') AS ok, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'N') AS coverage, round(avg(l_quantity), 4) AS avg_q, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a FROM lineitem GROUP BY 1",
    "host_concentration": "SELECT station, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT regexp_replace(lower(nullif(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), '')), '^((www|m)\\.)+', '') AS station, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, station LIMIT 5".replace("\\\\", "\\"),
    "pool_total_order": "SELECT s_suppkey, CAST(s_suppkey % 3 AS INTEGER) AS tier FROM supplier ORDER BY starts_with(s_name, 'Supplier#000000001') DESC, tier, s_acctbal DESC NULLS LAST, s_suppkey LIMIT 40",
    "first_per_host_24": "SELECT station, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(lower(nullif(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), '')), '^((www|m)\\.)+', '') AS station FROM pages) GROUP BY 1 ORDER BY page_id LIMIT 24".replace("\\\\", "\\"),
    "scan_rotation": "SELECT n_nationkey, CAST(CASE WHEN rn < 4 THEN rn ELSE 4 + ((rn - 4 - (15 % 21)) % 21 + 21) % 21 END AS INTEGER) AS slot FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS rn FROM nation)",
    "busy_flag_order": "SELECT o_orderkey, o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS busy FROM orders WHERE o_orderstatus = 'O' ORDER BY busy, o_orderdate NULLS FIRST, o_orderkey LIMIT 50",
    "due_followups": "SELECT o_orderkey, wait_days FROM (SELECT *, CAST(least(60, power(2, o_orderkey % 7)) AS BIGINT) AS wait_days, (SELECT max(o_orderdate) FROM orders) AS m FROM orders WHERE o_orderstatus = 'O') WHERE date_diff('day', o_orderdate, m) >= wait_days ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 100",
    "station_contagion": "SELECT page_id, station FROM (SELECT *, max(bad) OVER (PARTITION BY station) AS any_bad FROM (SELECT page_id, regexp_replace(lower(nullif(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), '')), '^((www|m)\\.)+', '') AS station, CAST(contains(html, 'class=\"ad\"') AS INTEGER) AS bad FROM pages)) WHERE any_bad = 0".replace("\\\\", "\\"),
}

QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (
        library_totals, library_facets_top12, library_lang_quality, library_page_quality, library_page_title, library_page_late_mat, library_search_escaped,
        library_tag_or_filter, library_usable_semi, no_active_task_anti, shelf_latest_per_book, shelf_status_counts, shelf_page_300, shelf_read_task_join,
        shelf_has_update, exact_hits_union, excluded_books_or_exists, find_stats, usage_dual_window, usage_grand_total, task_observation_pivot, task_state_case,
        bucket_counts, age_windows, admission_funnel, rejection_codes_explode, productive_scores, zero_yield_having, recent_union, requeue_candidates,
        requeue_by_reason, seeds_except_all_added, seeds_except_all_removed, full_outer_drift, lateral_top1_best_source, dense_rank_identity,
        row_number_prefetch, version_wins_fold, first_occurrence, last_occurrence, nearest_rank_percentile, upper_median_query, coverage_summary, source_stats,
        host_concentration, pool_total_order, first_per_host_24, scan_rotation, busy_flag_order, due_followups, budget_fold_query, station_contagion,
    )
}
