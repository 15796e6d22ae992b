"""Exact substring dedup by suffix arrays.

Every byte covered by a string of `length` bytes that also starts earlier is removed. Suffixes are compared
at anchors only: a window's anchor is the place of its least k-gram hash, so equal windows have equal anchors
at equal offsets, and suffixes with equal anchor grams meet in one partition. There the suffixes from the
anchor on, and the reversed ones before it, are sorted by the deep-shallow method; the two arrays with their
common prefix lengths tell, for each offset, which windows are equal and which of them is first.

Anchors whose gram occurs once in the corpus are told apart first by an exchange of hashes, so texts are
shipped only around the others. Within a block, anchors with equal surroundings are sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_DOCS, NULL_ID, PART_SCHEMA, RangeHash, at_parts, join_values, map_blocks, mix, parts_for, parts_of, read_block, split_values, squeeze, squeeze_array, squeeze_keys, to_blocks, unsqueeze, unsqueeze_array, unsqueeze_keys, with_answers
from .common import save
from .suffixsort import deep_shallow

GRAM = 32
#: Arrays of a block take about 80 times its bytes while its anchors are found.
BLOCK_BYTES = 500_000
#: Anchors that are sorted together, about; those of one gram always are.
RUN_ROWS = 20_000


class Anchors:
    """The windows of a block's texts and their anchors."""

    def __init__(self, block: int, payload: bytes, length: int):
        self.length = length
        self.ids, self.lengths, self.buf = read_block(payload)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.offsets = length - GRAM + 1  # places of an anchor in a window
        # Documents of a block in order of (doc_id, place in the block).
        self.place = np.empty(len(self.ids), np.int64)
        self.place[np.lexsort((np.arange(len(self.ids)), self.ids))] = np.arange(len(self.ids))
        self.uid = block * BLOCK_DOCS + np.arange(len(self.ids))
        n = np.maximum(self.lengths - length + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        self.windows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.starts[doc]  # where each begins
        if not len(self.windows):
            self.at = self.which = self.doc = self.left = self.right = np.zeros(0, np.int64)
            self.gram = self.around = np.zeros(0, np.uint64)
            return
        hashes = RangeHash(self.buf)
        grams = hashes.grams(GRAM)
        # The hash above, the place below: the least is the leftmost of the least hashes.
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= self.offsets:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = self.offsets - span
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        anchor = (low[self.windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        self.at = anchor[new]  # anchors in order of place; windows of an anchor follow each other
        self.which = np.cumsum(new) - 1
        self.doc = doc[new]
        self.gram = mix(grams[self.at])  # anchors have small hashes: mixed again, they spread over the partitions
        self.left = np.minimum(self.at - self.starts[self.doc], self.offsets - 1)
        self.right = np.minimum(self.ends[self.doc] - self.at, length)
        with np.errstate(over="ignore"):
            sides = (self.left * 1024 + self.right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            self.around = hashes.of(self.at - self.left, self.at + self.right) ^ sides

    def choose(self, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the anchors whose gram is elsewhere too: the first of each gram and surroundings, and the later ones."""
        picked = np.flatnonzero(twice)
        picked = picked[np.lexsort((self.at[picked], self.place[self.doc[picked]], self.around[picked], self.gram[picked]))]
        g, s = self.gram[picked], self.around[picked]
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])]) if len(picked) else np.zeros(0, bool)
        # Equal hashes say that a later one repeats its first; their bytes decide.
        later = np.flatnonzero(~first)
        if len(later):
            a, b = picked[later], picked[np.maximum.accumulate(np.where(first, np.arange(len(picked)), 0))[later]]
            k = np.arange(self.offsets - 1 + self.length)
            buf = np.concatenate([np.zeros(self.offsets, np.uint8), self.buf, np.zeros(self.length, np.uint8)])
            counts = (k >= (self.offsets - 1 - self.left[a])[:, None]) & (k < (self.offsets - 1 + self.right[a])[:, None])
            same = ((buf[(self.at[a] + 1)[:, None] + k] == buf[(self.at[b] + 1)[:, None] + k]) | ~counts).all(1)
            first[later] = ~(same & (self.left[a] == self.left[b]) & (self.right[a] == self.right[b]))
        return picked[first], picked[~first]  # firsts in order of gram


def _send_grams(length: int, parts: int):
    def run(block: int, payload: bytes) -> Iterator[pd.DataFrame]:
        keys = np.unique(Anchors(block, payload, length).gram)
        cuts = parts_of(keys, parts)
        rows = [(block, p, squeeze_keys(keys[cuts[p] : cuts[p + 1]])) for p in range(parts) if cuts[p + 1] > cuts[p]]
        yield pd.DataFrame(rows, columns=["block", "part", "payload"])

    return run


def _grams_of_more_blocks(x: pd.DataFrame) -> pd.DataFrame:
    keys = [unsqueeze_keys(p) for p in x["payload"]]
    _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    more = np.split(n[at] > 1, np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({"block": x["block"], "part": x["part"], "payload": [squeeze(np.packbits(m).tobytes()) for m in more]})


def _twice(a: Anchors, answers: dict[int, bytes], parts: int) -> np.ndarray:
    """Which anchors' grams occur at another anchor, here or in another block."""
    if not len(a.at):
        return np.zeros(0, bool)
    keys, at, n = np.unique(a.gram, return_inverse=True, return_counts=True)
    cuts = parts_of(keys, parts)
    more = [np.unpackbits(np.frombuffer(unsqueeze(answers[p]), np.uint8))[: cuts[p + 1] - cuts[p]] for p in range(parts) if cuts[p + 1] > cuts[p]]
    return (np.concatenate(more).astype(bool) | (n > 1))[at]


def _send_surroundings(length: int, parts: int):
    def run(block: int, payload: bytes, answers: dict[int, bytes]) -> pd.DataFrame:
        a = Anchors(block, payload, length)
        firsts, _ = a.choose(_twice(a, answers, parts))
        keys = a.gram[firsts]
        cuts = parts_of(keys, parts)
        width = a.offsets - 1 + length
        buf = np.concatenate([np.zeros(a.offsets, np.uint8), a.buf, np.zeros(length, np.uint8)])
        rows = []
        for p in range(parts):
            i = firsts[cuts[p] : cuts[p + 1]]
            if not len(i):
                continue
            # offsets - 1 bytes before the anchor and `length` from it; beyond the document's ends they don't count.
            around = buf[(a.at[i] + 1)[:, None] + np.arange(width)]
            d = a.doc[i]
            values = (a.gram[i], a.ids[d], a.uid[d], a.at[i] - a.starts[d], a.left[i].astype("<i4"), a.right[i].astype("<i4"))
            rows.append((block, p, join_values(*map(squeeze_array, values), squeeze(around.tobytes()))))
        return pd.DataFrame(rows, columns=["block", "part", "payload"])

    return run


def repeated_offsets(gram: np.ndarray, order_keys: tuple, left: np.ndarray, right: np.ndarray, around: np.ndarray, length: int) -> np.ndarray:
    """(anchors, offsets) bool: does the window that begins so many bytes before the anchor also start earlier?

    order_keys: doc id, uid and place, in which anchors are earlier or later.
    """
    n, offsets = len(gram), length - GRAM + 1
    out = np.zeros((n, offsets), bool)
    group = np.unique(gram, return_inverse=True)[1]
    live = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(live):
        return out
    live = live[np.lexsort(tuple(k[live] for k in order_keys[::-1]))]
    group, left, right, around = group[live], left[live], right[live], around[live]
    forth, lcp_forth = deep_shallow(group, around[:, offsets - 1 :])
    back, lcp_back = deep_shallow(group, np.ascontiguousarray(around[:, : offsets - 1][:, ::-1]))

    def classes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
        c = np.empty(len(order), np.int64)
        c[order] = np.cumsum(lcp < depth)
        return c

    for o in range(offsets):
        fits = np.flatnonzero((left >= o) & (right >= length - o))
        if not len(fits):
            continue
        same = classes(forth, lcp_forth, length - o)[fits] * (n + 1) + classes(back, lcp_back, o)[fits]
        later = np.ones(len(fits), bool)
        later[np.unique(same, return_index=True)[1]] = False
        out[live[fits[later]], o] = True
    return out


def _runs(gram: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in order of gram, in runs of about RUN_ROWS that keep a gram's rows together; lone grams are left out."""
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)
    size = np.diff(edge)
    order, size = order[np.repeat(size > 1, size)], size[size > 1]
    ends = np.cumsum(size)
    start = 0
    while start < len(order):
        end = int(ends[min(np.searchsorted(ends, start + RUN_ROWS), len(ends) - 1)])
        yield order[start:end]
        start = end


def _sort_suffixes(length: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        sent = [split_values(p) for p in x["payload"]]
        kinds = ("<u8", "<i8", "<i8", "<i8", "<i4", "<i4")
        cols = [np.concatenate([unsqueeze_array(s[k], kind) for s in sent]) for k, kind in enumerate(kinds)]
        sizes = [len(unsqueeze_array(s[4], "<i4")) for s in sent]
        width, at = 2 * length - GRAM, 0
        around = np.empty((sum(sizes), width), np.uint8)
        for s, n in zip(sent, sizes, strict=True):
            around[at : at + n] = np.frombuffer(unsqueeze(s[6]), np.uint8).reshape(n, width)
            at += n
        found = np.zeros((len(around), -(-(length - GRAM + 1) // 8)), np.uint8)
        for i in _runs(cols[0]):
            found[i] = np.packbits(repeated_offsets(cols[0][i], tuple(c[i] for c in cols[1:4]), cols[4][i], cols[5][i], around[i], length), axis=1)
        found = np.split(found, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"block": x["block"], "part": x["part"], "payload": [squeeze(f.tobytes()) for f in found]})

    return run


def _mark(length: int, parts: int):
    """(bytes to remove, Anchors) of a block."""

    def run(block: int, payload: bytes, answers: dict[int, bytes], masks: dict[int, bytes]) -> tuple[np.ndarray, Anchors]:
        a = Anchors(block, payload, length)
        gone = np.zeros(len(a.buf) + 1, np.int64)
        if len(a.at):
            firsts, later = a.choose(_twice(a, answers, parts))
            row = -(-a.offsets // 8)
            bits = np.concatenate([np.zeros((0, row), np.uint8), *(np.frombuffer(unsqueeze(masks[p]), np.uint8).reshape(-1, row) for p in sorted(masks))])
            repeated = np.zeros((len(a.at), row), np.uint8)
            repeated[firsts] = bits
            repeated[later] = 255
            o = a.at[a.which] - a.windows
            hit = a.windows[(repeated[a.which, o >> 3] >> (7 - (o & 7)).astype(np.uint8) & 1).astype(bool)]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + length, -1)
        return np.cumsum(gone)[:-1] > 0, a

    return run


def dedup_texts(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, md5) of documents (doc_id, text); kept: the bytes that remain,
    md5: of the whole text.

    A byte goes if any string of `length` bytes over it also starts earlier (smaller doc_id, or before it in
    the same document). Null texts are empty. Rows of one doc_id are taken in the order of the table; a null
    doc_id comes first. Other columns are left out; an empty table gives an empty result.
    """
    blocks = to_blocks(docs, block_bytes=BLOCK_BYTES)
    parts = parts_for(blocks)
    grams = at_parts(map_blocks(blocks, _send_grams(length, parts), PART_SCHEMA), _grams_of_more_blocks, PART_SCHEMA)
    grams = save(grams, "grams", "none")
    sent = with_answers(blocks, grams, _send_surroundings(length, parts), PART_SCHEMA)
    masks = at_parts(sent, _sort_suffixes(length), PART_SCHEMA)
    # Both answers meet their block together; those of the second kind have negative part numbers.
    both = grams.unionByName(masks.withColumn("part", (-1 - F.col("part")).cast("int")))
    mark = _mark(length, parts)

    def cut(block: int, payload: bytes, got: dict[int, bytes]) -> pd.DataFrame:
        gone, a = mark(block, payload, {p: v for p, v in got.items() if p >= 0}, {-1 - p: v for p, v in got.items() if p < 0})
        rows = []
        for i, s, e in zip(a.ids.tolist(), a.starts.tolist(), a.ends.tolist(), strict=True):
            g = gone[s:e]
            n = int(g.sum())
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if n else 0
            rows.append((i, e - s, n, spans, a.buf[s:e][~g].tobytes() if n else a.buf[s:e].tobytes(), hashlib.md5(a.buf[s:e]).hexdigest()))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "md5"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, md5 string"
    out = with_answers(blocks, both, cut, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


@F.pandas_udf(T.StringType())
def _as_text(kept: pd.Series) -> pd.Series:
    """Text of the bytes that remain, without characters of which a part was removed."""
    return kept.map(lambda b: b.decode("utf-8", "ignore"))


def drop_repeated_text(docs: DataFrame, length: int = 100) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) with repeated text cut out; rows of which nothing is left go.

    Rows meet their cut text by doc_id and text; of rows with both alike, the first in order of the other columns
    is the one that keeps its text. Where a cut falls inside a character, the character goes whole. Empty and null
    texts stay, as empty texts.
    """
    alike = Window.partitionBy("__id", "__md5")
    cut = dedup_texts(docs, length).where("n_removed < n_bytes or n_bytes = 0")
    cut = cut.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.col("md5").alias("__md5"), _as_text("kept").alias("__text"), "n_removed")
    cut = cut.withColumn("__k", F.row_number().over(alike.orderBy("n_removed", "__text")))
    rest = docs.withColumn("__id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("__md5", F.md5(F.coalesce("text", F.lit("")))).drop("text")
    rest = rest.withColumn("__k", F.row_number().over(alike.orderBy("lang", "source", "n_chars")))
    out = rest.join(cut, ["__id", "__md5", "__k"]).withColumn("text", F.col("__text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
