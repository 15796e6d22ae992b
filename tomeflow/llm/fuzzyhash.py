"""Context-triggered piecewise hashing of texts, and likeness of fingerprints.

A rolling hash over the last 7 bytes ends a piece where its low bits are all ones: on average every 4, 8, 16, ...
bytes by the number of bits, the block size. Each piece is one of 64 characters. A fingerprint
`block:signature:signature` has the signatures at the smallest block size that makes no more than 64 ends, and at
twice that size, so nothing is cut off however long a text is. Fingerprints are compared by edit distance at the
block sizes that both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NULL_ID, PART_BYTES
from .common import bound_batches, free_memory, partitions, save

WINDOW, LEAST_BITS, MOST_BITS, MOST_ENDS = 7, 2, 32, 64
#: Bytes that are hashed at a time; bytes of a partition of documents, about.
SLICE, RANGE_BYTES = 1 << 20, 4 * PART_BYTES
#: Characters that two signatures must have in a row, to tell chance from likeness; fewer for short ones.
COMMON_RUN = 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "u1")

_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 32, 256, np.uint32)
_FACTOR = np.uint32(0x2C9277B5)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def rolling(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of each byte of data with the WINDOW - 1 bytes in front of it; before: those of data's first byte, as far as there are."""
    values = np.zeros(len(data) + WINDOW - 1, np.uint32)
    values[WINDOW - 1 :] = _BYTES[data]
    values[WINDOW - 1 - len(before) : WINDOW - 1] = _BYTES[before]
    h = np.zeros(len(data), np.uint32)
    for k in range(WINDOW):  # multiplied and added, oldest byte first
        h = h * _FACTOR + values[k : k + len(data)]
    return _mixed(h)


def _slices(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, rolling hashes, low ones of each) of the slices of a text."""
    for a in range(0, len(data), SLICE):
        h = rolling(data[a : a + SLICE], data[max(a - WINDOW + 1, 0) : a])
        low = ~h
        bits = np.bitwise_count((low & -low) - np.uint32(1))  # ones below the lowest zero
        yield a, h, bits


def signatures(text: bytes) -> tuple[int, str, str]:
    """(bits of the block size, signature at it, signature at twice it)."""
    data = np.frombuffer(text, "u1")
    kept = list(_slices(data)) if len(data) <= SLICE else None
    count = np.zeros(MOST_BITS + 1, np.int64)
    for _, _, bits in kept or _slices(data):
        count += np.bincount(bits, minlength=MOST_BITS + 1)
    ends = np.cumsum(count[::-1])[::-1]  # ends of pieces at each block size
    level = next(b for b in range(LEAST_BITS, MOST_BITS + 2) if b > MOST_BITS or ends[b] <= MOST_ENDS)
    pieces: list[list[int]] = [[0], [0]]
    open_ = [False, False]
    for _, h, bits in kept or _slices(data):
        for s in (0, 1):
            at = np.flatnonzero(bits >= level + s) + 1
            sums = np.add.reduceat(h, np.concatenate([[0], at[at < len(h)]]), dtype=np.uint32).tolist()
            pieces[s][-1] += sums[0]
            pieces[s] += sums[1:]
            open_[s] = not (len(at) and at[-1] == len(h))
            if not open_[s]:
                pieces[s].append(0)
    out = []
    for s in (0, 1):
        values = np.array([p & 0xFFFFFFFF for p in pieces[s][: len(pieces[s]) - (not open_[s])]], np.uint32)
        out.append(ALPHABET[_mixed(values) >> np.uint32(26)].tobytes().decode())
    return level, out[0], out[1]


def fingerprint(text: bytes) -> str:
    level, one, two = signatures(text)
    return f"{1 << level}:{one}:{two}"


def _squeezed(s: str) -> str:
    """s with no more than three equal characters in a row: long runs say little."""
    return "".join(c for i, c in enumerate(s) if i < 3 or not c == s[i - 1] == s[i - 2] == s[i - 3])


def edit_distance(a: str, b: str) -> int:
    """Least number of characters to put in or take out to make a into b, by the longest common subsequence in bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(b) - len(a) + 2 * row.bit_count()


def _alike(a: str, b: str) -> float:
    a, b = _squeezed(a), _squeezed(b)
    run = min(COMMON_RUN, max(1, min(len(a), len(b)) // 2))
    if not a or not b or not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    return 1 - edit_distance(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the best of the block sizes that both have; 1 for equal fingerprints, 0 where no size is shared."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    pairs = [(a1, b1), (a2, b2)] if n == m else [(a2, b1)] if 2 * n == m else [(a1, b2)] if n == 2 * m else []
    return max((_alike(x, y) for x, y in pairs), default=0.0)


def half_replaced(text: str, other: str) -> str:
    """text with its last half replaced by as many first characters of the other, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Beside results, what a partition's neighbours need: its place, and the texts of its first and last row.
_EDGES = f"{_COLUMNS}, edge string, part int, edge_text binary"
_NAMES = [c.split()[0] for c in _EDGES.split(", ")]


def _text(b: bytes) -> str:
    return b.decode("utf-8", "surrogateescape")


def _row(doc_id: int, text: bytes, own: str, following: bytes, its: str) -> tuple:
    s = _text(text)
    edited = half_replaced(s, _text(following)).encode("utf-8", "surrogateescape")
    print_ = fingerprint(edited)
    return doc_id, len(s), hashlib.sha256(edited).hexdigest(), own, print_, likeness(own, print_), likeness(own, its)


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _EDGES.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _neighbours(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted partition but its last, which goes on with the partition's first."""
    from pyspark import TaskContext

    part, last, first = TaskContext.get().partitionId(), None, True
    edge = lambda name, i, t: (i, None, None, None, None, None, None, name, part, t)
    for f in frames:
        rows = []
        for i, t in zip(f.column("id").to_pylist(), f.column("t"), strict=True):
            t = t.as_py()
            now = (i, t, last[2] if last and last[1] == t else fingerprint(t))
            if first:
                rows.append(edge("first", i, t))
                first = False
            if last:
                rows.append((*_row(*last, t, now[2]), None, part, None))
            last = now
        if rows:
            yield _batch(rows, _SCHEMA)
    if last:
        yield _batch([edge("last", last[0], last[1])], _SCHEMA)
    free_memory()


def _closing(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of partitions' last rows, each with the text that follows."""
    schema = pa.schema(list(_SCHEMA)[:7])
    for f in frames:
        rows = [_row(i, a, fingerprint(a), b, fingerprint(b)) for i, a, b in zip(*(f.column(c).to_pylist() for c in ("doc_id", "edge_text", "following")), strict=True)]
        yield _batch(rows, schema)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of documents (doc_id, text).

    The edited text has its last half replaced by the beginning of the next document's text, by ascending doc_id,
    after the last the first. A null text is empty; a null doc_id comes first and stays null; rows that repeat an id
    follow each other by their texts; a single row is its own next; an empty table gives an empty result. Other
    columns are not read. Documents are sorted in ranges, one shuffle; ranges meet by their first and last rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    total = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges = max(partitions(spark), -(-total // RANGE_BYTES))
    ordered = src.repartitionByRange(ranges, "id", F.xxhash64("t")).sortWithinPartitions("id", "t")
    found = save(ordered.mapInArrow(_neighbours, _EDGES), "neighbours")
    known = sorted(r.part for r in found.where("edge = 'last'").select("part").collect())  # a row for each partition
    if not known:
        return found.select(*_NAMES[:7])
    after = spark.createDataFrame(list(zip(known, known[1:] + known[:1], strict=True)), "part int, following_part int")
    firsts = found.where("edge = 'first'").select(F.col("part").alias("following_part"), F.col("edge_text").alias("following"))
    open_ = found.where("edge = 'last'").select("doc_id", "part", "edge_text").join(after, "part").join(firsts, "following_part")
    closed = open_.select("doc_id", "edge_text", "following").mapInArrow(_closing, _COLUMNS)
    out = found.where("edge is null").select(*_NAMES[:7]).unionByName(closed)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
