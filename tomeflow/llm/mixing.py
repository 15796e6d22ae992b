"""Mixing sources to target weights by a low-discrepancy schedule.

Points of the golden-ratio sequence are mapped through the cumulative targets of the sources; each slot so
gets a source, and its rank among that source's slots names a block. Blocks are equal-token cuts of the
source's documents in shuffled (hashed) order; ranks beyond the last block start a further pass. Slots of a
source beyond its quota are skipped. Slots, blocks and documents meet by joins on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, partitions, row_hash, save, tidy, unpacked

#: The fractional part of the golden ratio as an odd multiple of 2**-31: all points of a period differ.
GOLDEN, BITS = 1327217885, 31
#: Buckets of the shuffled order within a source.
BUCKETS = 4096
#: Slots that one step of the schedule numbers together.
CHUNK = 1 << 16
#: Sources up to which their table is broadcast.
MOST_BROADCAST = 10_000


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight; none above cap times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes)}, total
    while open_ and left > 0:
        w = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / w > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def slot_sources(start: int, stop: int, edges: np.ndarray) -> np.ndarray:
    """The source of each slot: where its golden-ratio point falls among the cumulative targets."""
    i = np.arange(start, stop, dtype=np.int64) & ((1 << BITS) - 1)
    u = (i * GOLDEN & ((1 << BITS) - 1)) / float(1 << BITS)
    return np.minimum(np.searchsorted(edges, u, side="right"), len(edges) - 1)


def schedule(spark, targets: list[float], quotas: list[int], parts: int) -> DataFrame:
    """(slot, source_no, rank) of every slot that its source's quota admits, in as many chunks as needed."""
    edges = np.cumsum(targets) / max(sum(targets), 1e-300)
    need = [q / max(t / sum(targets), 1e-12) for q, t in zip(quotas, targets, strict=True) if q and t]
    n = int(max(need, default=0)) + 64 * len(targets) if need else 0  # all quotas are met within these
    chunks = -(-n // CHUNK)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f.id:
                no, n_of = np.unique(slot_sources(c * CHUNK, (c + 1) * CHUNK, edges), return_counts=True)
                yield pd.DataFrame({"chunk": c, "source_no": no, "n": n_of})

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f.id:
                s = slot_sources(c * CHUNK, (c + 1) * CHUNK, edges)
                order = np.argsort(s, kind="stable")
                within = np.empty(len(s), np.int64)
                within[order] = np.arange(len(s)) - np.searchsorted(s[order], s[order])
                yield pd.DataFrame({"chunk": c, "slot": c * CHUNK + np.arange(len(s)), "source_no": s, "within": within})

    ids = spark.range(0, chunks, 1, max(1, min(parts, chunks)))
    w = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = ids.mapInPandas(tidy(count), "chunk long, source_no int, n long").select(
        "chunk", "source_no", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")
    )
    limit = spark.createDataFrame(pd.DataFrame({"source_no": np.arange(len(quotas), dtype=np.int32), "quota": np.array(quotas, np.int64)}), "source_no int, quota long")
    slots = ids.mapInPandas(tidy(number), "chunk long, slot long, source_no int, within long")
    return (
        slots.hint("merge").join(before, ["chunk", "source_no"])
        .withColumn("rank", F.col("before") + F.col("within"))
        .join(_small(limit, len(quotas)), "source_no")
        .where(F.col("rank") < F.col("quota"))
        .select("slot", "source_no", "rank")
    )


def _small(dim: DataFrame, rows: int) -> DataFrame:
    """dim, broadcast if its rows are few."""
    return F.broadcast(dim) if rows <= MOST_BROADCAST else dim


def mix(df: DataFrame, key: str, size: str, source: str, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 64) -> DataFrame:
    """df with source_size, target and taken, the words of each row that the mix takes, repeats counted.

    Sources are ordered by code point, null last, and weighted by the cycle of weights. Sizes of sources are
    the one thing brought to the driver, a row a source. Rows of size 0 or null take nothing; an empty table gives
    an empty result; rows with equal keys follow each other in shuffled order, by size and by a hash of the whole
    row. Other columns are kept, whatever they are called, but for the three new ones, which are replaced.
    """
    spark, columns = df.sparkSession, df.columns
    per = df.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("n")).collect()
    per = sorted(per, key=lambda r: (r.s is None, (r.s or "").encode("utf-32-be")))
    sizes = [int(r.n or 0) for r in per]
    wts = [float(weights[i % len(weights)]) for i in range(len(per))]
    targets = water_fill(sizes, wts, share * sum(sizes), cap)
    blocks = [-(-n // block) for n in sizes]
    quotas = []
    for t, n, b in zip(targets, sizes, blocks, strict=True):
        passes = int(t // n) if n else 0  # whole passes take the source's size, the rest goes by blocks
        quotas.append(passes * b + min(b, int((t - passes * n) / block + 0.5)))
    dim = spark.createDataFrame(
        [(r.s, i, sizes[i], targets[i], blocks[i]) for i, r in enumerate(per)] or [(None, 0, 0, 0.0, 0)],
        "__s string, __no int, source_size long, target double, __blocks long",
    )
    own = F.col("__r")
    x = packed(df).withColumn("__k", own.getField(key)).withColumn("__n", F.coalesce(own.getField(size), F.lit(0)).cast("long"))
    x = x.withColumn("__src", own.getField(source)).join(_small(dim, len(per)), F.col("__src").eqNullSafe(F.col("__s")))
    x = x.withColumn("__h", F.xxhash64(F.lit("shuffle"), "__k")).withColumn("__all", F.xxhash64(*[own.getField(c) for c, t in df.dtypes if "map<" not in t]))
    x = x.withColumn("__b", F.pmod(F.shiftright("__h", 20), F.lit(BUCKETS)).cast("int"))

    ahead = Window.partitionBy("__no").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy("__no", "__b").agg(F.sum("__n").alias("n")).select(
        "__no", "__b", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__base")
    )
    inner = Window.partitionBy("__no", "__b").orderBy("__h", "__k", "__n", "__all").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(base, ["__no", "__b"])
    x = x.withColumn("__start", F.col("__base") + F.col("__in")).withColumn("__row", F.monotonically_increasing_id())
    x = save(x.select("__r", "source_size", "target", "__no", "__n", "__blocks", "__start", "__row"), "mix")

    # Block b of a source holds its words from b * block on; a document is cut where blocks end.
    first, last = F.floor(F.col("__start") / block), F.floor((F.col("__start") + F.col("__n") - 1) / block)
    parts_ = x.where(F.col("__n") > 0).select("__row", "__no", "__start", "__n", F.explode(F.sequence(first, last)).alias("__block"))
    words = F.least(F.col("__start") + F.col("__n"), (F.col("__block") + 1) * block) - F.greatest(F.col("__start"), F.col("__block") * block)
    parts_ = parts_.select("__row", "__no", "__block", words.alias("__words"))

    n_blocks = dim.select(F.col("__no").alias("source_no"), F.col("__blocks").alias("n_blocks"))
    slots = schedule(spark, targets, quotas, partitions(spark)).join(_small(n_blocks, len(per)), "source_no")
    times = slots.select("source_no", (F.col("rank") % F.col("n_blocks")).alias("block_no")).groupBy("source_no", "block_no").agg(F.count("*").alias("times"))
    taken = (
        parts_.join(times.hint("merge"), (F.col("__no") == F.col("source_no")) & (F.col("__block") == F.col("block_no")))
        .groupBy("__row")
        .agg(F.sum(F.col("__words") * F.col("times")).alias("taken"))
    )
    out = x.join(taken, "__row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return unpacked(out, columns, ["source_size", "target", "taken"])


def mix_documents(docs: DataFrame) -> DataFrame:
    """documents as the mix takes them: each row as often as its taken words make it, rounded, and none that it
    doesn't take. Documents without words (empty or null texts) are not taken. Rows that are equal in all columns
    are taken equally often, as the most taken of them.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = save(docs.select(row_hash(docs).alias("hash"), "doc_id", size.alias("size"), "source"), "sizes")
    mixed = mix(sized, "doc_id", "size", "source").where("size > 0")
    times = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("__times")).where("__times > 0")
    out = docs.withColumn("__row", row_hash(docs)).join(times, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
