"""Connected components of a table of links by large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save

MOST_ROUNDS = 100
#: Links that a task writes: later rounds have no more links than the first, so their tables are cut by its count.
LINKS_A_TASK = 250_000


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (a > b)."""
    if large:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = near.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node that links reach.

    Links may repeat, point both ways or to themselves; those with nulls are left out. Each round is a written
    table, so a lost executor costs a reread only. Nodes are longs.
    """
    x = links.select(F.col(a).cast("long").alias("p"), F.col(b).cast("long").alias("q")).where("p is not null and q is not null and p <> q")
    x = x.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()
    cur = save(x, "links")
    mark = lambda d: d.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    before = mark(cur)
    for _ in range(MOST_ROUNDS):
        if not before.n:
            break
        new = save(_stars(_stars(cur, True), False).coalesce(-(-before.n // LINKS_A_TASK)), "links")
        now = mark(new)
        discard(cur)
        cur = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links still change after {MOST_ROUNDS} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
