"""Best-two-fit packing of documents into fixed-length sequences.

A sequence is filled greedily with the longest piece that fits; then its smallest piece is replaced by two
unpacked pieces that together fit the gap so expanded more tightly. Pieces are dealt by a hash into blocks of
a bounded number of rows, each packed alone, so the work is spread and a block leaves one loose end at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .tokens import encode_documents

#: Pieces that are packed together, about.
BLOCK_ROWS = 16_384


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes of lengths, none above capacity; every index in exactly one bin."""
    stock: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stock.setdefault(lengths[i], []).append(i)
    have = sum(1 << n for n in stock)  # bit n: a piece of length n is unpacked
    turned = sum(1 << (capacity - n) for n in stock)  # the same, bit capacity - n
    low = [(1 << (n + 1)) - 1 for n in range(capacity + 1)]

    def take(n: int) -> int:
        nonlocal have, turned
        rows = stock[n]
        i = rows.pop()
        if not rows:
            del stock[n]
            have ^= 1 << n
            turned ^= 1 << (capacity - n)
        return i

    def give(i: int) -> None:
        nonlocal have, turned
        n = lengths[i]
        if n not in stock:
            stock[n] = []
            have |= 1 << n
            turned |= 1 << (capacity - n)
        stock[n].append(i)

    def pair(least: int, most: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum in least..most."""
        for total in range(most, least - 1, -1):
            # Bit a of both: lengths a and total - a are there.
            move = capacity - total
            both = have & (turned >> move if move >= 0 else turned << -move) & low[min(total, capacity)]
            while both:
                a = both.bit_length() - 1
                b = total - a
                if a < b:
                    break
                if a != b or len(stock[a]) > 1:
                    return a, b
                both ^= 1 << a
        return None

    bins = []
    while have:
        gap, members = capacity, []
        while gap and (fit := have & low[gap]):
            i = take(fit.bit_length() - 1)
            members.append(i)
            gap -= lengths[i]
        if gap and have and len(members) > 1:
            smallest = members[-1]  # greedy filling takes longer pieces first
            n = lengths[smallest]
            if found := pair(n + 1, n + gap):
                members.pop()
                members += [take(found[0]), take(found[1])]
                give(smallest)
        bins.append(members)
    return bins


def cut_pieces(ids: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece, start, length, ids) of rows of encode_documents(); only documents above capacity are cut.

    The first piece takes the remainder, the others are full.
    """
    n = F.octet_length("ids").cast("long") / 4
    x = ids.select(key, "ids", n.cast("long").alias("__n"))
    first = F.when(F.col("__n") % capacity > 0, F.col("__n") % capacity).otherwise(F.least("__n", F.lit(capacity)))
    count = F.greatest(F.ceil(F.col("__n") / capacity).cast("int"), F.lit(1))
    x = x.withColumn("__first", first.cast("long")).withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    x = x.withColumn("start", F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("__first") + (F.col("piece") - 1) * capacity).cast("long"))
    x = x.withColumn("length", F.when(F.col("piece") == 0, F.col("__first")).otherwise(F.lit(capacity)).cast("long"))
    own = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return x.select(key, "piece", "start", "length", own.alias("ids"))


def pack(pieces: DataFrame, key: str, capacity: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pieces with sequence_id and offset, from columns key, piece and length.

    No sequence exceeds capacity and offsets have no gaps. Full pieces are sequences of their own. Ties are
    broken by key and piece; equal rows are packed apart; an empty table gives an empty result.
    pieces is read twice, so save() it if it is costly.
    """
    cols = pieces.columns
    short = pieces.where(F.col("length") < capacity)
    n = short.count()
    blocks = max(1, -(-n // block_rows))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(_key, f: pd.DataFrame) -> pd.DataFrame:
        block = int(f["__block"].iloc[0])
        f = f.sort_values([key, "piece"], kind="stable").reset_index(drop=True)
        seq, off = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
        lengths = f["length"].astype(int).tolist()
        for b, members in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = (block << 20) + b, at
                at += lengths[i]
        return f[cols].assign(sequence_id=seq, offset=off)

    block = F.pmod(F.xxhash64(F.lit("pack"), key, "piece"), F.lit(blocks))
    packed = short.withColumn("__block", block).groupBy("__block").applyInPandas(run, schema)
    full = pieces.where(F.col("length") >= capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def sequences(pieces: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces with ids and their places."""
    at = placed.select(key, "piece", "sequence_id", "offset")
    joined = pieces.select(key, "piece", "ids").join(at, [key, "piece"])
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a capacity's worth of tokens at most
    joined = joined.groupBy("sequence_id").agg(rows.alias("r"))
    return joined.select("sequence_id", F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["ids"])), "")).alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pieces of documents (doc_id, text) with their places and the crc32 of their ids.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one end id.
    """
    pieces = cut_pieces(encode_documents(docs, "doc_id", "text", tokenizer), "doc_id", capacity)
    pieces = save(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(pieces, "doc_id", capacity, block_rows)
