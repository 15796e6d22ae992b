"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits, low chunk first. Level 0 holds a byte for each token; a bitmap beside
each level says which tokens continue on the next, and a rank directory (ones before each 512th bit) finds
their place there. So any token is read without decoding others.

A segment is one binary value (layout below), with up to SEGMENT_TOKENS tokens of whole documents in
ascending id order. Segments are rows of a Parquet table, which Spark's writer commits as a whole: tasks
that are retried or lost leave nothing behind, and any store that Spark reaches will do.

Layout, little endian: magic 4s, version u4, documents u4, tokens u8, tokens before in this part u8, levels
u4; documents' ids i8 each; documents' ends (tokens) u8 each; for each level: tokens u8, chunk bytes, bitmap
bytes, directory u8 each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import NULL_ID
from .common import bound_batches, new_path, partitions, tidy
from .tokens import encoder, default_tokenizer, groups

MAGIC, VERSION = b"DACT", 1
HEAD = struct.Struct("<4sIIQQI")
SEGMENT_TOKENS = 1 << 20
RANK_BITS = 512


def write_segment(doc_ids: list[int], ids: list[bytes], before: int) -> bytes:
    """A segment of documents, each given as little-endian uint32 ids."""
    rest = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum([len(x) // 4 for x in ids], dtype="<u8")
    total, levels = len(rest), []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(bits).astype("<u8"), np.arange(0, len(bits), RANK_BITS // 8)) if len(bits) else np.zeros(0, "<u8")
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype("u1").tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = HEAD.pack(MAGIC, VERSION, len(doc_ids), total, before, len(levels))
    return head + np.array(doc_ids, "<i8").tobytes() + ends.tobytes() + b"".join(levels)


class Segment:
    """Reader of one segment."""

    def __init__(self, data: bytes):
        magic, version, n, self.tokens, self.before, levels = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a segment of token ids")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.ends = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
        at += 16 * n
        self.levels = []
        for _ in range(levels):
            (m,) = struct.unpack_from("<Q", data, at)
            at += 8
            n_bits, n_ranks = -(-m // 8), -(-(-(-m // 8)) // (RANK_BITS // 8)) + 1
            chunks = np.frombuffer(data, "u1", m, at)
            bits = np.frombuffer(data, "u1", n_bits, at + m)
            ranks = np.frombuffer(data, "<u8", n_ranks, at + m + n_bits)
            at += m + n_bits + 8 * n_ranks
            self.levels.append((chunks, bits, ranks))

    def rank(self, level: int, i: int) -> int:
        """Continued tokens before position i of a level."""
        _, bits, ranks = self.levels[level]
        j, r = divmod(i, RANK_BITS)
        begin = j * RANK_BITS // 8
        whole = int(np.bitwise_count(bits[begin : begin + r // 8]).sum())
        part = int(bits[begin + r // 8] & ((1 << r % 8) - 1)).bit_count() if r % 8 else 0
        return int(ranks[j]) + whole + part

    def token(self, i: int) -> int:
        """The id at position i: one byte and one rank for each level."""
        value = shift = level = 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, level, shift = self.rank(level, i), level + 1, shift + 8

    def slice(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids of positions start to stop."""
        chunks, bits, _ = self.levels[level]
        out = chunks[start:stop].astype("<u4")
        if level + 1 < len(self.levels) and stop > start:
            more = np.unpackbits(bits[start >> 3 : -(-stop // 8)], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            if n := int(more.sum()):
                at = self.rank(level, start)
                out[more] |= self.slice(at, at + n, level + 1) << 8
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode documents (doc_id, text) and write them to path in ascending doc_id order.

    A null text counts as empty; a null doc_id is kept as NULL_ID and so comes first; rows with equal ids follow
    each other; an empty table makes an empty store.
    """
    name, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, enc, before, n, seq = TaskContext.get().partitionId(), encoder(name), 0, 0, 0
        keys: list[int] = []
        rows: list[bytes] = []
        for f in frames:
            texts, ids = f["t"].tolist(), f["k"].tolist()
            for a, b in groups(texts):
                for k, x in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    if keys and n + len(x) // 4 + 1 > segment_tokens:
                        yield pd.DataFrame({"part": [part], "seq": [seq], "tokens": [n], "payload": [write_segment(keys, rows, before)]})
                        before, n, seq, keys, rows = before + n, 0, seq + 1, [], []
                    keys.append(k)
                    rows.append(x + end)
                    n += len(x) // 4 + 1
        if keys:
            yield pd.DataFrame({"part": [part], "seq": [seq], "tokens": [n], "payload": [write_segment(keys, rows, before)]})

    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    bound_batches(docs.sparkSession)
    src = src.repartitionByRange(partitions(docs.sparkSession), "k").sortWithinPartitions("k")
    segments = src.mapInPandas(tidy(run), "part int, seq int, tokens long, payload binary")
    segments.write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a store; start counts the ids before it in all parts."""
    store = spark.read.schema("part int, seq int, tokens long, payload binary").parquet(path)
    parts = sorted(store.groupBy("part").agg(F.sum("tokens").alias("n")).collect())  # a row for each written part
    starts, total = {}, 0
    for r in parts:
        starts[r.part], total = total, total + r.n

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, payload in zip(f["part"], f["payload"], strict=True):
                s = Segment(payload)
                begin = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                ids = s.slice(0, s.tokens).tobytes()
                rows = [ids[4 * a : 4 * b] for a, b in zip(begin.tolist(), s.ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": s.doc_ids, "start": begin + s.before + starts[part], "n_tokens": s.ends - begin, "ids": rows})

    out = store.select("part", "payload").mapInPandas(tidy(run), "doc_id long, start long, n_tokens long, ids binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def store_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write documents to a new store in the shared folder and read it back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
