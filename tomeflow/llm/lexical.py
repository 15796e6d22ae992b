"""Ranked search by Fagin's threshold algorithm over shards of documents.

A document's row of the forward index holds the terms that the items ask for. Each task makes a shard of its rows:
a list a term, sorted by impact, and the rows themselves for random access. An item reads its lists round-robin; a
document met for the first time is scored whole from its row; reading stops once the threshold, the score that a
document with the next unread impact of every list would have, is strictly below the k-th score. A task's best go
on, and the best of these are the result, so no list of a frequent term is ever in one place.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NULL_ID
from .common import bound_batches, discard, free_memory, save

#: Letters and digits of ASCII, and all beyond it: of UTF-8 bytes the same runs as of code points.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Items are searched together up to this many, or bytes of text; more are searched in further blocks.
BLOCK_ITEMS, BLOCK_BYTES = 10_000, 8 << 20
#: Postings of a shard; entries of each list that are read first, doubled each round.
SHARD_POSTINGS, FIRST_DEPTH = 2_000_000, 32


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # of bytes, lower() changes A-Z only


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Saved (doc_id, n, terms, tfs): a row for each document with a term; terms are those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, terms, tfs = [], [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("t"), strict=True):
                found = terms_of(t.as_py())
                if found:
                    have = [(vocabulary[w], c) for w, c in Counter(found).items() if w in vocabulary]
                    ids.append(i)
                    ns.append(len(found))
                    terms.append([w for w, _ in have])
                    tfs.append([c for _, c in have])
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(ns, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})
        free_memory()

    bound_batches(docs.sparkSession)
    src = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("text").cast("binary").alias("t"))
    return save(src.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"), "forward")


class Shard:
    """Impact-sorted lists of some documents, and their rows."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """sizes: terms of each row; lengths: all terms of each document, n_terms of the whole corpus of n_docs."""
        self.doc_ids, self.terms, self.weights = doc_ids, terms, weights
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(len(doc_ids)), sizes)
        m = 100 - 50 + (50 * lengths * n_docs) // n_terms
        self.impact = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc])
        order = np.lexsort((-self.impact, terms))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_at = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.seen, self.weight_of = np.full(len(doc_ids), -1, np.int64), np.zeros(len(weights), np.int64)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Random access: whole scores of documents, each of which has a term of the item."""
        size = self.at[docs + 1] - self.at[docs]
        begin = np.cumsum(size) - size
        flat = np.repeat(self.at[docs] - begin, size) + np.arange(int(size.sum()))
        return np.add.reduceat(self.weight_of[self.terms[flat]] * self.impact[flat], begin)

    def search(self, item: int, terms: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, doc ids), highest first, of the k best of this shard and those known before."""
        terms = terms[self.weights[terms] > 0]
        weight = self.weights[terms]
        self.weight_of[terms] = weight
        begin, end = self.list_at[terms], self.list_at[terms + 1]
        score, ids = best
        depth, step = 0, FIRST_DEPTH
        while (begin + depth < end).any():
            read = [self.list_doc[a + depth : min(a + depth + step, b)] for a, b in zip(begin.tolist(), end.tolist(), strict=True) if a + depth < b]
            new = np.unique(np.concatenate(read))
            new = new[self.seen[new] != item]
            self.seen[new] = item
            depth, step = depth + step, step * 2
            if len(new):
                s = self.scores(new)
                if len(score) >= k:
                    new, s = new[s >= score[-1]], s[s >= score[-1]]
                score, ids = np.concatenate([score, s]), np.concatenate([ids, self.doc_ids[new]])
                top = np.lexsort((ids, -score))[:k]
                score, ids = score[top], ids[top]
            left = begin + depth < end
            threshold = int((weight[left] * self.list_impact[(begin + depth)[left]]).sum())
            if len(score) >= k and threshold < score[-1]:
                break
        self.weight_of[terms] = 0
        return score, ids


def _search(items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        held: list[tuple[np.ndarray, ...]] = []

        def shard() -> None:
            s = Shard(*(np.concatenate(c) for c in zip(*held, strict=True)), weights, n_docs, n_terms)
            for i, terms in enumerate(items):
                best[i] = s.search(i, terms, k, best[i])

        for b in batches:
            size = b.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((b.column("doc_id").to_numpy(), b.column("n").to_numpy(), size, b.column("terms").flatten().to_numpy().astype(np.int64), b.column("tfs").flatten().to_numpy()))
            if sum(len(h[3]) for h in held) >= SHARD_POSTINGS:
                shard()
                held = []
        if held:
            shard()
        for i, (score, ids) in enumerate(best):
            if len(score):
                yield pa.record_batch({"item": pa.array([i] * len(score), pa.int32()), "doc_id": ids, "score": score})
        free_memory()

    return run


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Items (item_id, text) in blocks of bounded size, each with its terms."""
    block, n = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        text = (r.text or "").encode()
        block.append((r.item_id, set(terms_of(text))))
        n += len(text)
        if len(block) >= BLOCK_ITEMS or n >= BLOCK_BYTES:
            yield block
            block, n = [], 0
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple[int | None, set[bytes]]], k: int) -> DataFrame:
    """Saved result of one block of items."""
    spark = docs.sparkSession
    words = sorted(set().union(*(t for _, t in block)))
    vocabulary = {w: i for i, w in enumerate(words)}
    index = forward_index(docs, vocabulary)
    total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total.docs, total.terms or 0
    weights = np.zeros(len(words), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # no more than the block's terms
        weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    terms = [np.array(sorted(vocabulary[w] for w in t), np.int64) for _, t in block]
    found = index.where(F.size("terms") > 0).mapInArrow(_search(terms, weights, n_docs, n_terms, k), "item int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")).alias("rank")
    ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")
    top = found.select("*", rank).where(F.col("rank") <= k).join(F.broadcast(ids), "item")  # no more than BLOCK_ITEMS rows
    out = save(top.select("item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score"), "ranked")
    discard(index)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each item, by score and doc_id.

    A document's score sums, over the item's terms, floor(1000 ln((2N + 2) / (2df + 1))) * (10^9 tf div (1000 tf +
    20 m)), with m = 50 + (50 n N div L), in whole numbers; N, L and df are counted over all documents. Null and
    empty texts have no terms and are never found; an item without terms has no rows. A null doc_id comes before
    others of its score; rows that repeat an id are documents of their own, as are items that repeat theirs. Empty
    tables give an empty result; other columns are not read.
    """
    out = [_search_block(docs, b, k) for b in item_blocks(items)]
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


#: The same in SQL; the ranges are the ASCII characters that part terms.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts)) AS n_terms FROM d
), p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""
