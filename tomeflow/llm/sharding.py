"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is a fixed number of cells. Virtual nodes of each shard sit on cells; a row's key hashes to a
cell and belongs to the next virtual node clockwise. Loads are bounded: a shard that is full passes what
arrives to the next shard clockwise that has room. Arrival order is fixed (cells in bit-reversed order,
rows of a cell by a second hash), so the placement is the one the sequential procedure would give, but
only the counts of the cells, a table of fixed size, are walked; rows meet their segment by a join.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash

CELL_BITS = 16
CELLS = 1 << CELL_BITS


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    spots = {}
    for s in range(n_shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "little") % CELLS
            spots.setdefault(cell, s)
    return sorted(spots.items())


def capacities(n_rows: int, n_shards: int, slack: float) -> list[int]:
    """Rows each shard may take; without slack, counts are at most one apart."""
    if slack > 0:
        return [-(-int(n_rows * (1 + slack) + 1) // n_shards)] * n_shards
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def place_cells(counts: dict[int, int], n_shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first rank, end rank, shard, first slot); at most CELLS + n_shards of them."""
    nodes = ring(n_shards, vnodes)
    room = capacities(sum(counts.values()), n_shards, slack)
    follow = []  # the distinct shards clockwise from each virtual node
    for i in range(len(nodes)):
        seen = dict.fromkeys(nodes[(i + k) % len(nodes)][1] for k in range(len(nodes)))
        follow.append(list(seen)[:n_shards])
    used, out = [0] * n_shards, []
    at, owner = 0, []
    for cell in range(CELLS):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        owner.append(at % len(nodes))
    for k in range(CELLS):
        cell = int(f"{k:0{CELL_BITS}b}"[::-1], 2)
        left, rank = counts.get(cell, 0), 0
        for s in follow[owner[cell]] if left else ():
            take = min(left, room[s] - used[s])
            if take > 0:
                out.append((cell, rank, rank + take, s, used[s]))
                used[s], rank, left = used[s] + take, rank + take, left - take
            if not left:
                break
    return out


def shard_rows(df: DataFrame, key: str, n_shards: int, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """df with shard int and slot long (gapless from 0 in each shard).

    slack 0 bounds loads at the mean, so that counts are at most one apart; more slack moves fewer rows
    when shards come or go. Rows with null keys are dealt by a hash of the whole row; rows with equal keys are
    ordered by such a hash and spread by rank as others are; an empty table gives an empty result; other columns
    are kept, whatever they are called, but for shard and slot, which are replaced.
    """
    spark = df.sparkSession
    spot = F.when(F.col(key).isNull(), F.col("__all")).otherwise(F.xxhash64(F.lit("ring"), F.col(key)))
    x = df.select(*[F.col(c) if c == key else F.col(c).alias(f"__r{i}") for i, c in enumerate(df.columns)], row_hash(df).alias("__all"))
    x = x.withColumn("__cell", F.pmod(spot, F.lit(CELLS)).cast("int"))
    got = x.groupBy("__cell").agg(F.count("*").alias("n")).toArrow().to_pydict()
    plan = place_cells(dict(zip(got["__cell"], got["n"], strict=True)), n_shards, vnodes, slack)
    plan = pd.DataFrame(plan or [(0, 0, 0, 0, 0)], columns=["__c", "__from", "__to", "__shard", "__slot"])
    segments = F.broadcast(spark.createDataFrame(plan))  # CELLS + n_shards rows at most, whatever the input
    w = Window.partitionBy("__cell").orderBy(F.xxhash64(F.lit("rank"), F.col(key)), F.col(key), "__all")
    x = x.withColumn("__rank", F.row_number().over(w) - 1)
    on = (F.col("__cell") == F.col("__c")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    return x.join(segments, on).select(
        *[F.col(c if c == key else f"__r{i}").alias(c) for i, c in enumerate(df.columns) if c not in ("shard", "slot")],
        F.col("__shard").cast("int").alias("shard"),
        (F.col("__slot") + F.col("__rank") - F.col("__from")).cast("long").alias("slot"),
    )
