"""Generic relational operators: DataFrame in, DataFrame out, with explicit order and as-of time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Rows that meet every condition given; None is no condition."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(and_, given)) if given else df


def representative(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number`, from 1, in a total order."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_late(df: DataFrame, key: str, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """As page(), but only the sort columns and key are ranked; wide columns are fetched for the page's rows."""
    ids = page(df, order, number, size).select(key)
    return df.join(F.broadcast(ids), key, "left_semi")  # a page of rows


def facet(df: DataFrame, key: str, name: str, most: int) -> DataFrame:
    """Counts of the most frequent values, ties by name."""
    return df.groupBy(F.col(key).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(name)).limit(most)


def latest_value(df: DataFrame, key: str, value: str, by: str, name: str) -> DataFrame:
    """(key, name): value at the greatest `by`, without a window."""
    return df.groupBy(key).agg(F.max_by(value, by).alias(name))


def multiset_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a as often as they exceed those of b."""
    return a.exceptAll(b)


def anti_join_null_safe(a: DataFrame, b: DataFrame, a_key: Column, b_key: Column) -> DataFrame:
    return a.join(b, a_key.eqNullSafe(b_key), "left_anti")


def rotate(df: DataFrame, order: Sequence[Column], skip: int, rotation: int, window: int, total: int, name: str = "slot") -> DataFrame:
    """Positions in order; those from `skip` on are rotated by rotation * window. Ranks come from a total order."""
    rn = F.row_number().over(Window.orderBy(*order)) - 1
    n = max(1, total - skip)
    shift = (rotation * window) % n
    slot = F.when(F.col("__rn") < skip, F.col("__rn")).otherwise(F.lit(skip) + F.pmod(F.col("__rn") - skip - shift, F.lit(n)))
    return df.withColumn("__rn", rn).withColumn(name, slot.cast("int")).drop("__rn")


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of value by key."""
    return df.groupBy(*keys).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, p in shares.items()])


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The element at n // 2 of the sorted values, from 0, by key; counted by ranks, so that no list is built."""
    w = Window.partitionBy(*keys)
    x = df.where(F.col(value).isNotNull()).withColumn("__n", F.count("*").over(w)).withColumn("__rn", F.row_number().over(w.orderBy(value)))
    return x.where(F.col("__rn") == F.floor(F.col("__n") / 2) + 1).select(*keys, F.col(value).alias(name))


def version_wins(df: DataFrame, key: str, stamp: str, position: str, payload: str) -> DataFrame:
    """The payload that wins by key: of two stamps above 0 that differ the newer, else the later row.

    The pairwise rule is no total order where stamps of 0 mix in, so rows are folded in order.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(stamp).alias("s"), F.col(payload).alias("v"))))
    start = F.struct(F.lit(None).cast("long").alias("p"), F.lit(0).cast("long").alias("s"), F.lit(None).cast(df.schema[payload].dataType).alias("v"))

    def step(a: Column, x: Column) -> Column:
        keep = a["p"].isNotNull() & (a["s"] > 0) & (x["s"] > 0) & (a["s"] > x["s"])
        new = F.struct(x["p"].cast("long").alias("p"), x["s"].cast("long").alias("s"), x["v"].alias("v"))
        return F.when(keep, a).otherwise(new)

    return df.groupBy(key).agg(F.aggregate(rows, start, step).alias("w")).select(key, F.col("w.v").alias(payload), F.col("w.s").alias(stamp))


def budget_fold(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each key taken in order while they fit the budget; one too big is skipped, later ones still may fit."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("n"))))
    kind = df.schema[order].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("taken"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["n"] <= budget
        return F.when(fits, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["taken"], F.array(x["o"])).alias("taken"))).otherwise(a)

    folded = df.groupBy(key).agg(F.aggregate(rows, start, step).alias("f"))
    return folded.select(key, F.explode("f.taken").alias(order))


def dual_window(df: DataFrame, keys: Sequence[str], ts: str, value: str, as_of: Column, hours: int) -> DataFrame:
    """Totals over all time and over the trailing hours before as_of, in one scan."""
    recent = F.col(ts) > as_of - F.expr(f"INTERVAL {hours} HOURS")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.sum(value), 4).alias("total"),
        F.count_if(recent).alias("n_recent"),
        F.round(F.coalesce(F.sum(F.when(recent, F.col(value))), F.lit(0.0)), 4).alias("total_recent"),
    )
