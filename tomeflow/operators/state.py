"""Incremental state as batch operators: last write wins, window counters, sessions, transitions, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write_wins(df: DataFrame, keys: list[str], stamp: str, tie: str, payload: list[str]) -> DataFrame:
    """The payload of the greatest (stamp, tie) of each key, combined before the shuffle."""
    best = F.max_by(F.struct(*payload), F.struct(stamp, tie)).alias("__p")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__p.{c}").alias(c) for c in payload])


def window_counts(df: DataFrame, keys: list[str], ts: str, minutes: int, limit: int) -> DataFrame:
    """(keys, window_start, attempts, allowed, retry_after_s): fixed windows; the rest of a window is waited out over the limit."""
    start = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes").getField("start")
    x = df.groupBy(*keys, start.alias("window_start")).agg(F.count("*").alias("attempts"), F.max(F.col(ts).cast("timestamp")).alias("last"))
    wait = F.lit(60 * minutes) - (F.unix_timestamp("last") - F.unix_timestamp("window_start"))
    x = x.withColumn("allowed", F.col("attempts") <= limit)
    return x.select(*keys, "window_start", "attempts", "allowed", F.when(F.col("allowed"), 0).otherwise(wait).cast("int").alias("retry_after_s"))


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """(key, session_start, n): runs of events with no gap above the limit."""
    s = F.session_window(F.col(ts).cast("timestamp"), f"{gap_minutes} minutes")
    return df.groupBy(key, s.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), "n")


def reclaim(df: DataFrame, status: str, started: str, tries: str, as_of: Column, stale_days: int, most_tries: int) -> DataFrame:
    """df with next_status: stale running rows go back to pending, or fail after their last try."""
    stale = (F.col(status) == "O") & (F.col(started) < as_of - F.expr(f"INTERVAL {stale_days} DAYS"))
    nxt = F.when(stale & (F.col(tries) >= most_tries), "failed").when(stale, "pending").otherwise(F.col(status))
    return df.withColumn("next_status", nxt)


def append_state(turns: DataFrame, key: str, order: str, text: str, known: DataFrame) -> DataFrame:
    """(key, state): baseline, unchanged, appended or rebased against known (key, n, h).

    h is a hash of the first n entries in order, so an append keeps it.
    """
    w = Window.partitionBy(key).orderBy(order)
    x = turns.join(known, key, "left").withColumn("rn", F.row_number().over(w))
    head = F.array_sort(F.collect_list(F.when(F.col("rn") <= F.coalesce("n", F.lit(0)), F.struct("rn", F.md5(text).alias("m")))))
    g = x.groupBy(key).agg(F.count("*").alias("now"), F.max("n").alias("n"), F.max("h").alias("h"), F.md5(F.array_join(F.transform(head, lambda r: r["m"]), "")).alias("got"))
    state = F.when(F.col("n").isNull(), "baseline").when((F.col("now") < F.col("n")) | (F.col("got") != F.col("h")), "rebased").when(F.col("now") == F.col("n"), "unchanged").otherwise("appended")
    return g.select(key, state.alias("state"))


def prefix_state(turns: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """(key, n, h) of the first `most` entries, as append_state() expects it."""
    w = Window.partitionBy(key).orderBy(order)
    x = turns.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    head = F.array_sort(F.collect_list(F.struct("rn", F.md5(text).alias("m"))))
    return x.groupBy(key).agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(head, lambda r: r["m"]), "")).alias("h"))
