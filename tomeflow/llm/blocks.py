"""Blocks: some MB of whole documents as one compressed value, and arrays dealt between blocks and partitions.

Operators that look up something for every word, shingle or window of a text keep texts in blocks. A block
sends each partition a sorted slice of its distinct 64-bit keys, so a frequent key costs one entry a block;
the partition answers in the same order. Blocks are a written table, hence the same at every reading.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_memory, lean_memory, partitions, save, tidy

BLOCK_BYTES = 4_000_000
BLOCK_DOCS = 1 << 20
NULL_ID = -(1 << 63)
#: Bytes of text that a key range answers for, about.
PART_BYTES = 8_000_000
#: Longer words are hashed by a digest.
WORD_BYTES = 64
PART_SCHEMA = "block long, part int, payload binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeeze_array(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses small or sorted numbers well."""
    a = np.ascontiguousarray(a)
    return squeeze(a.view("u1").reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")


def unsqueeze_array(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(unsqueeze(data), "u1")
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(dtype)


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences."""
    return squeeze_array(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze_array(data, "<u8"), dtype=np.uint64)


def join_values(*values: bytes) -> bytes:
    return struct.pack(f"<B{len(values)}Q", len(values), *map(len, values)) + b"".join(values)


def split_values(data: bytes) -> list[bytes]:
    n = data[0]
    at, out = 1 + 8 * n, []
    for size in struct.unpack_from(f"<{n}Q", data, 1):
        out.append(data[at : at + size])
        at += size
    return out


def read_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, byte lengths, bytes of all texts in a row)."""
    ids, lengths, text = split_values(payload)
    return np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8"), np.frombuffer(unsqueeze(text), "u1")


def to_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Saved table (block, payload, n_bytes). Null texts are empty, null keys NULL_ID; rows stay apart, equal or not.

    A row's uid is block * BLOCK_DOCS + its place.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, n = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        texts: list[bytes] = []

        def block() -> pd.DataFrame:
            lengths = np.fromiter(map(len, texts), "<i8", len(texts))
            payload = join_values(np.array(ids, "<i8").tobytes(), lengths.tobytes(), squeeze(b"".join(texts)))
            return pd.DataFrame({"block": [(part << 20) + seq], "payload": [payload], "n_bytes": [int(lengths.sum())]})

        for f in frames:
            for k, t in zip(f["k"].tolist(), f["t"], strict=True):
                ids.append(k)
                texts.append(t)
                n += len(t)
                if n >= block_bytes or len(ids) == BLOCK_DOCS:
                    yield block()
                    ids, texts, seq, n = [], [], seq + 1, 0
        if ids:
            yield block()

    bound_batches(docs.sparkSession)
    k = F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))
    src = docs.select(k.alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return save(src.mapInPandas(tidy(run), "block long, payload binary, n_bytes long"), "blocks", "none")


def parts_for(blocks: DataFrame) -> int:
    """Key ranges that the texts of blocks are dealt to: as many as their bytes ask for, however many partitions are set."""
    n = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(partitions(blocks.sparkSession), -(-n // PART_BYTES))


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's slice of sorted keys begins, and the end."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def map_blocks(blocks: DataFrame, f: Callable[[int, bytes], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """f(block, payload) of every block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for block, payload in zip(x["block"], x["payload"], strict=True):
                yield from f(block, payload)

    return blocks.mapInPandas(tidy(run), schema)


def at_parts(sent: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of all that blocks have sent to a key range; parts_for() bounds the expected size of one."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        lean_memory()
        out = f(x.sort_values("block", ignore_index=True))
        free_memory()
        return out

    return sent.groupBy("part").applyInPandas(run, schema)


def with_answers(blocks: DataFrame, answers: DataFrame, f: Callable[[int, bytes, dict[int, bytes]], pd.DataFrame], schema: str) -> DataFrame:
    """f(block, payload, {part: answer}) of every block."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        lean_memory()
        out = f(int(a["block"].iloc[0]), a["payload"].iloc[0], dict(zip(b["part"].tolist(), b["payload"], strict=True)))
        free_memory()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


# --- hashes of byte ranges and words -------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 64, 256, np.uint64)
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def load_words(data: bytes, at: np.ndarray, size: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Bytes at..at + size of data as n uint64 columns, zeros after the end; data has 8 * n bytes more than at + size."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    for k in range(n):
        yield words[np.minimum(at + 8 * k, len(words) - 1)] & masks[np.clip(size - 8 * k, 0, 8)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class RangeHash:
    """of(a, b): hashes of byte ranges a to b of a buffer, equal for equal bytes, 64 bits."""

    def __init__(self, buf: np.ndarray):
        pw, self.inverse = powers(len(buf) + 1)
        h = np.empty(len(buf) + 1, np.uint64)
        h[0] = 0
        np.cumsum(_BYTES[buf] * pw[: len(buf)], dtype=np.uint64, out=h[1:])
        self.h = h

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.h[b] - self.h[a]) * self.inverse[a])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of every k bytes in a row."""
        n = len(self.h) - k
        return mix((self.h[k:] - self.h[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_hashes(data: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, 8 bytes at a time; those of more than WORD_BYTES bytes by a digest of their own."""
    h = size.astype(np.uint64) * _BASE
    left, k = np.arange(len(at)), 0
    while len(left) and k < WORD_BYTES:
        (w,) = load_words(data, at[left] + k, size[left] - k, 1)
        with np.errstate(over="ignore"):
            h[left] = mix((h[left] + np.uint64(0x9E3779B97F4A7C15)) ^ w)
        k += 8
        left = left[size[left] > k]
    for i in left.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[at[i] : at[i] + size[i]], digest_size=8).digest(), "little")
    return h


def block_words(lengths: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, A-Z in lower case; words of each document)."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(lengths), np.int64)
    data = buf.tobytes().lower() + bytes(8)  # of bytes, lower() changes A-Z only
    inside = ~_IS_SEP[np.frombuffer(data, np.uint8)[: len(buf)]]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = starts[lengths > 0]
    begins[first] = inside[first]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = ends[lengths > 0] - 1
    stops[last] = inside[last]
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    n = np.searchsorted(a, ends) - np.searchsorted(a, starts)
    return word_hashes(data, a, b - a), n
