"""How filters interact: what each removes in every order they can be applied in, by first-failure lookup.

A document's failures are a mask of five bits. A table of 32 masks by 120 orders tells at which step an order
removes it; each task looks its rows up, counts them by label, order and step into one array a part, and the
arrays are summed. All figures follow from the sums.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NULL_ID
from .common import WORD_SEP, free_memory

FILTERS = "ABCDE"
ORDERS = list(itertools.permutations(range(len(FILTERS))))
N_ORDERS, N_STEPS, N_MASKS, N_LABELS = len(ORDERS), len(FILTERS), 1 << len(FILTERS), 4
#: The step, from 0, at which each order removes a mask; N_STEPS where it is kept.
FIRST_FAILURE = np.array([[next((i for i, f in enumerate(o) if m >> f & 1), N_STEPS) for o in ORDERS] for m in range(N_MASKS)], np.int64)
#: Of a part: documents by (label, order, step or kept), then by mask.
CELLS = N_LABELS * N_ORDERS * (N_STEPS + 1)
WIDTH = CELLS + N_MASKS
#: Parts that a task counts before it sends its arrays on; tasks' arrays of a part are summed in so many sums first.
PARTS_HELD, SUMS = 256, 32

_ARRAYS = "part string, salt int, n array<long>"
_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, mask, n): documents with equal text, lang and labels counted together.

    Filters: A fewer than 100 words, B under 80 % distinct words, C over 10 % capitals A-Z, D any of #$%&*|, E a
    smaller doc_id has the same text. Copies share A to D, so a text's rows meet as counts with their least id, and
    a text that many documents have costs a row a task. label is 1 for quality, 2 for toxic, 3 for both.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, WORD_SEP), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (n < 100, 100 * distinct < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), text.rlike("[#$%&*|]"))
    mask = sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_hash"), mask.alias("mask"),
    )
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("bad"))
    rows = rows.join(marks, "id", "left").withColumn("label", F.coalesce(F.col("good") + F.col("bad"), F.lit(0)))
    per_id = rows.groupBy("id", "text_hash", "part", "label", "mask").agg(F.count("*").alias("n"))  # dealt by id already
    alike = per_id.groupBy("text_hash", "part", "label", "mask").agg(F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum("n").alias("n"))
    first = F.when(F.col("least") == F.min("least").over(Window.partitionBy("text_hash")), F.col("n_least")).otherwise(0)
    alike = alike.withColumn("first", first)
    both = F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    return alike.select("part", "label", F.explode(both).alias("x")).where("x.n > 0").select("part", "label", "x.mask", "x.n")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One array of counts for each part of a task."""
    from pyspark import TaskContext

    salt, held = TaskContext.get().partitionId() % SUMS, {}

    def out() -> pa.RecordBatch:
        return pa.record_batch({"part": pa.array(list(held), pa.string()), "salt": pa.array([salt] * len(held), pa.int32()), "n": pa.array(list(held.values()), pa.list_(pa.int64()))})

    for b in batches:
        part = b.column("part").dictionary_encode()
        code = part.indices.to_numpy(zero_copy_only=False)
        label, mask, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "mask", "n"))
        for i, name in enumerate(part.dictionary.to_pylist()):
            at = code == i
            cell = (label[at, None] * N_ORDERS + np.arange(N_ORDERS)) * (N_STEPS + 1) + FIRST_FAILURE[mask[at]]
            sums = np.bincount(cell.ravel(), np.repeat(n[at], N_ORDERS), CELLS)  # doubles, exact to 2 ** 53
            sums = np.concatenate([sums, np.bincount(mask[at], n[at], N_MASKS)]).astype(np.int64)
            held[name] = held[name] + sums if name in held else sums
            if len(held) >= PARTS_HELD:
                yield out()
                held = {}
    if held:
        yield out()
    free_memory()


def _arrays(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    n = t.column("n")
    n = n.combine_chunks() if isinstance(n, pa.ChunkedArray) else n
    return n.flatten().to_numpy(zero_copy_only=False).reshape(len(n), WIDTH)


def _sum(t: pa.Table) -> pa.Table:
    """The sum of a part's arrays."""
    return pa.table({"part": t.column("part")[:1], "salt": t.column("salt")[:1], "n": pa.array([_arrays(t).sum(0)], pa.list_(pa.int64()))})


def report(sums: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of the 600 rows, by order and step, that follow from one part's sums."""
    order = np.array(ORDERS)
    removed = sums[:CELLS].reshape(N_LABELS, N_ORDERS, N_STEPS + 1)
    masks, every = sums[CELLS:], removed.sum(0)
    lost, total = every[:, :N_STEPS], masks.sum()
    fails = np.array([masks[np.arange(N_MASKS) >> f & 1 == 1].sum() for f in range(N_STEPS)])
    alone = np.array([masks[1 << f] for f in range(N_STEPS)])
    shapley = np.bincount(order.ravel(), lost.ravel(), N_STEPS).astype(np.int64)
    out = {"kept": total - np.cumsum(lost, 1), "removed": lost, "redundant": fails[order] - lost, "unique_fails": alone[order]}
    out |= {"good_lost": removed[1::2].sum(0)[:, :N_STEPS], "toxic_lost": removed[2:].sum(0)[:, :N_STEPS], "shapley": shapley[order]}
    return {k: v.ravel() for k, v in out.items()}


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["".join(FILTERS[f] for f in o) for o in ORDERS for _ in range(N_STEPS)]
    for b in batches:
        for part, sums in zip(b.column("part").to_pylist(), _arrays(b), strict=True):
            cols = {"part": [part] * len(names), "filter_order": names, "step": pa.array(np.tile(np.arange(1, N_STEPS + 1), N_ORDERS), pa.int32())}
            yield pa.record_batch(cols | {k: pa.array(v, pa.int64()) for k, v in report(sums).items()})


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (lang, null as empty), order of the five filters and step.

    Of documents (doc_id, text, lang) and labels (doc_id, quality, toxic): kept after the step, removed at it,
    redundant (fails the step's filter, removed earlier), unique_fails (fails no other), good_lost and toxic_lost
    (removed here and labelled so), shapley (removed by the filter, summed over all orders). Null texts are empty. A
    null doc_id is smaller than all others and has no labels; rows that repeat an id count each, and none of them is
    smaller than another; an id labelled twice has both rows' marks. An empty table gives an empty result; other
    columns are not read.
    """
    arrays = failures(docs, labels).mapInArrow(_count, _ARRAYS)
    some = arrays.groupBy("part", "salt").applyInArrow(_sum, _ARRAYS)
    return some.groupBy("part").applyInArrow(_sum, _ARRAYS).mapInArrow(_reports, _RESULT)


#: The same in SQL.
SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
  SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
  FROM w
), g AS (
  SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, count(*) AS n FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL
), l(i, c) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS p
  FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), r AS (
  SELECT part, filter_order, p, fails, good, bad, n, coalesce(list_position(list_transform(p, lambda i: fails[i]), true), 6) AS fell FROM g, o
), s AS (
  SELECT part, filter_order, step, p[step] AS k,
    sum(n) FILTER (fell > step) AS kept, sum(n) FILTER (fell = step) AS removed, sum(n) FILTER (fell < step AND fails[p[step]]) AS redundant,
    sum(n) FILTER (fails[p[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(n) FILTER (fell = step AND good) AS good_lost, sum(n) FILTER (fell = step AND bad) AS toxic_lost
  FROM r, generate_series(1, 5) q(step) GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM s
"""
