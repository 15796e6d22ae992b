"""Further predicates, joins, ranks and maintenance queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import jsonpath as J
from ..operators import relational as R
from ..sources.tables import table as t


def ilike_search(s, d):
    return t(s, d, "documents").where(F.col("text").ilike("%THE %")).groupBy("lang").agg(F.count("*").alias("n"))


def json_text_search(s, d):
    """Events whose JSON, as text, holds what was typed, in any case."""
    return t(s, d, "events").where(F.col("props").ilike('%"K": 2%')).select("event_id", "event_type")


def tri_state_filter(s, d):
    """Rows by a condition that may be true, false or unknown."""
    x = t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left").withColumn("good", F.col("quality") == 1)
    state = F.when(F.col("good").isNull(), "unknown").when(F.col("good"), "yes").otherwise("no")
    return x.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def distinct_from_changes(s, d):
    """Orders whose status is distinct from the customer's one before, null counting as a value."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = t(s, d, "orders").withColumn("before", F.lag("o_orderstatus").over(w))
    return x.where(~F.col("before").eqNullSafe(F.col("o_orderstatus"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def pattern_list_semi(s, d):
    """Parts whose type fits one of a list of patterns; the list is a table of a few rows."""
    patterns = s.createDataFrame([("%BRASS",), ("SMALL%",), ("%PLATED%",)], "pattern string")
    p = t(s, d, "part")
    return p.join(F.broadcast(patterns), F.expr("p_type LIKE pattern"), "left_semi").select("p_partkey", "p_type")


def filter_menu(s, d):
    """A menu of filters of which only those that are set count."""
    asked = {"lang": "en", "least": 200, "most": None, "source": None}
    conditions = [F.col("lang") == asked["lang"], F.col("n_chars") >= asked["least"], F.col("n_chars") <= asked["most"] if asked["most"] else None, F.col("source") == asked["source"] if asked["source"] else None]
    return R.where_all(t(s, d, "documents"), conditions).groupBy("source").agg(F.count("*").alias("n"))


def composite_key_join(s, d):
    """The line that each order's greatest price names, by order and line."""
    li = t(s, d, "lineitem")
    top = li.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("l_linenumber"))
    return li.join(top, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


def left_lateral_latest(s, d):
    """Each customer with the latest order, or none: the best row by key, combined before the shuffle."""
    o = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return t(s, d, "customer").join(o, "c_custkey", "left").select("c_custkey", "latest")


def latest_aggregate_base(s, d):
    """Base rows with the latest event of each user and totals over all of theirs."""
    e = t(s, d, "events")
    both = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    base = e.select("user_id").distinct()
    return base.join(both, "user_id", "left").select("user_id", "latest", "events", "errors")


def reverse_list(s, d):
    """Turns of a conversation, last first."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))  # a conversation's turns
    return t(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.reverse(turns), lambda r: r["role"]), ",").alias("roles"))


def functional_variant_dedupe(s, d):
    """Of pages that differ in scheme, host prefix, query or a slash only, the first."""
    key = F.regexp_replace(F.regexp_replace(F.lower("url"), r"^https?://(www\.|m\.)?", ""), r"[?#].*$|/+$", "")
    return t(s, d, "pages").groupBy(key.alias("key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("variants"))


def priority_rank(s, d):
    """The order of each customer that comes first by a map of priorities."""
    rank = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}
    place = F.coalesce(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("o_orderpriority")], F.lit(9))
    best = F.min(F.struct(place.alias("p"), "o_orderkey")).alias("b")
    return t(s, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", F.col("b.o_orderkey").alias("o_orderkey"), F.col("b.p").cast("int").alias("place"))


def iso_times(s, d):
    return t(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


def base64_lenient(s, d):
    """Text from base64 that may be padded or not, or no base64 at all."""
    n = F.col("event_id") % 3
    coded = F.rtrim(F.base64(F.encode("event_type", "utf-8")), F.lit("="))
    typed = F.when(n == 0, F.base64(F.encode("event_type", "utf-8"))).when(n == 1, coded).otherwise("*" )
    padded = F.rpad(typed, (F.ceil(F.length(typed) / 4) * 4).cast("int"), "=")
    return t(s, d, "events").select("event_id", F.when(typed.rlike("^[A-Za-z0-9+/]+=*$"), F.decode(F.unbase64(padded), "utf-8")).alias("decoded"))


def no_source_classes(s, d):
    """Why a part has no usable offer: none at all, only returned ones, or only dear ones."""
    li = t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("fresh"), F.count_if((F.col("l_returnflag") == "N") & (F.col("l_discount") >= 0.05)).alias("cheap"))
    x = t(s, d, "part").join(li, "p_partkey", "left")
    kind = F.when(F.col("n").isNull(), "none").when(F.col("fresh") == 0, "returned").when(F.col("cheap") == 0, "dear").otherwise("usable")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("parts"))


def defer_finish_transitions(s, d):
    """What comes after each state: running tasks finish, or are deferred while tries are left."""
    tries = F.col("o_orderkey") % 4
    nxt = F.when(F.col("o_orderstatus") == "F", "done").when((F.col("o_orderstatus") == "P") & (tries < 3), "deferred").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return t(s, d, "orders").groupBy("o_orderstatus", nxt.alias("next")).agg(F.count("*").alias("n"))


def retest_decay(s, d):
    """Waits that double with each failure of a user, from a day to at most thirty."""
    x = t(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    return x.select("user_id", F.least(F.lit(30.0), F.pow(F.lit(2.0), F.least("failures", F.lit(20)).cast("double"))).cast("int").alias("wait_days"))


def position_mismatch_ratio(s, d):
    """Share of turns whose role differs from the one at their place in the conversation before."""
    c = t(s, d, "conversations").select("conv_id", "turn", "role")
    o = c.select((F.col("conv_id") + 1).alias("conv_id"), "turn", F.col("role").alias("other"))
    return c.join(o, ["conv_id", "turn"]).groupBy("conv_id").agg(F.round(F.avg((F.col("role") != F.col("other")).cast("int")), 6).alias("ratio"))


def event_days(s, d):
    """Every day between the first event and the last, with its events."""
    days = t(s, d, "events").select(F.to_date("ts").alias("day"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    busy = days.groupBy("day").agg(F.count("*").alias("n"))
    return span.join(busy, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def json_array_filter(s, d):
    """Lines of an order's JSON that a path's filter admits."""
    rows = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q")))))  # an order's lines
    x = t(s, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("j"))
    return x.select("l_orderkey", F.array_join(J.find_all(F.col("j"), "$[?(@.q > 30)].n"), ",").alias("lines"), J.find(F.col("j"), "$[-1].n").cast("int").alias("last"))


def json_deep_value(s, d):
    return t(s, d, "events").select("event_id", J.find(F.col("props"), "$..k").cast("int").alias("k"))


SQL = {
    "ilike_search": "SELECT lang, count(*) AS n FROM documents WHERE text ILIKE '%THE %' GROUP BY 1",
    "json_text_search": "SELECT event_id, event_type FROM events WHERE props ILIKE '%\"K\": 2%'",
    "tri_state_filter": "SELECT CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS state, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "distinct_from_changes": "SELECT o_orderstatus, count(*) AS n FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS DISTINCT FROM o_orderstatus GROUP BY 1",
    "pattern_list_semi": "SELECT p_partkey, p_type FROM part WHERE EXISTS (SELECT 1 FROM (VALUES ('%BRASS'), ('SMALL%'), ('%PLATED%')) v(pattern) WHERE p_type LIKE pattern)",
    "filter_menu": "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND n_chars >= 200 GROUP BY 1",
    "composite_key_join": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN (SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, l_linenumber)) AS l_linenumber FROM lineitem GROUP BY 1) USING (l_orderkey, l_linenumber)",
    "left_lateral_latest": "SELECT c_custkey, o.o_orderkey AS latest FROM customer c LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true",
    "latest_aggregate_base": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1",
    "reverse_list": "SELECT conv_id, string_agg(role, ',' ORDER BY turn DESC, role DESC) AS roles FROM conversations GROUP BY 1",
    "functional_variant_dedupe": "SELECT regexp_replace(regexp_replace(lower(url), '^https?://(www\\.|m\\.)?', ''), '[?#].*$|/+$', '', 'g') AS key, min(page_id) AS page_id, count(*) AS variants FROM pages GROUP BY 1".replace("\\\\", "\\"),
    "priority_rank": "SELECT o_custkey, o_orderkey, p AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p, o_orderkey) AS rn FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 9 END AS p FROM orders)) WHERE rn = 1",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events",
    "base64_lenient": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_type END AS decoded FROM events",
    "no_source_classes": "SELECT CASE WHEN n IS NULL THEN 'none' WHEN fresh = 0 THEN 'returned' WHEN cheap = 0 THEN 'dear' ELSE 'usable' END AS kind, count(*) AS parts FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS fresh, count(*) FILTER (WHERE l_returnflag = 'N' AND l_discount >= 0.05) AS cheap FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1",
    "defer_finish_transitions": "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' AND o_orderkey % 4 < 3 THEN 'deferred' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'pending' END AS next, count(*) AS n FROM orders GROUP BY 1, 2",
    "retest_decay": "SELECT user_id, CAST(least(30, pow(2, least(count(*) FILTER (WHERE event_type = 'error'), 20))) AS INT) AS wait_days FROM events GROUP BY 1",
    "position_mismatch_ratio": "SELECT a.conv_id, round(avg(CASE WHEN a.role <> b.role THEN 1 ELSE 0 END), 6) AS ratio FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id + 1 AND a.turn = b.turn GROUP BY 1",
    "event_days": "SELECT CAST(g AS DATE) AS day, count(ts) AS n FROM (SELECT unnest(generate_series(CAST(a AS DATE), CAST(b AS DATE), INTERVAL 1 DAY)) AS g FROM (SELECT min(ts) AS a, max(ts) AS b FROM events)) LEFT JOIN events ON CAST(ts AS DATE) = CAST(g AS DATE) GROUP BY 1",
    "json_array_filter": "SELECT l_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (WHERE CAST(trunc(l_quantity) AS INT) > 30), '') AS lines, CAST(max(l_linenumber) AS INT) AS last FROM lineitem GROUP BY 1",
    "json_deep_value": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
}

QUERIES = {
    f.__name__: f
    for f in (
        ilike_search, json_text_search, tri_state_filter, distinct_from_changes, pattern_list_semi, filter_menu, composite_key_join, left_lateral_latest,
        latest_aggregate_base, reverse_list, functional_variant_dedupe, priority_rank, iso_times, base64_lenient, no_source_classes, defer_finish_transitions,
        retest_decay, position_mismatch_ratio, event_days, json_array_filter, json_deep_value,
    )
}
