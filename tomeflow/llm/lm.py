"""Language-model scores by deleted interpolation.

P(w | v) mixes the maximum-likelihood bigram and unigram estimates and a uniform one. The mixture weights
depend on how often the context v was seen (buckets by powers of two) and are learned by expectation
maximisation on held-out counts: each training token in turn is deleted from the counts that predict it.
Counts cover all training documents; what reaches the driver is a histogram of fixed size.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NULL_ID, PART_SCHEMA, at_parts, block_words, join_values, map_blocks, mix, parts_for, parts_of, read_block, split_values, squeeze_array, squeeze_keys, to_blocks, unsqueeze_array, unsqueeze_keys, with_answers
from .common import save

END, START = np.uint64(0xE4D0000000000001), np.uint64(0x57A2700000000001)
BUCKETS = 20
#: Steps of a probability's logarithm to base 2 in the histogram that the weights are learned from.
STEPS, LEVELS = 8, 320
ROUNDS = 60


def is_training(doc_id: int) -> bool:
    return doc_id == NULL_ID or zlib.crc32(str(doc_id).encode()) % 10 != 0


class Tokens:
    """Tokens of a block: distinct unigram and bigram keys, and each token's place among them."""

    def __init__(self, payload: bytes):
        self.ids, lengths, buf = read_block(payload)
        words, n = block_words(lengths, buf)
        self.n_tokens = n + 1
        self.ends = np.cumsum(self.n_tokens)
        tokens = np.empty(len(words) + len(n), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[self.ends - 1] = True
        tokens[is_end], tokens[~is_end] = END, words
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.ends - self.n_tokens] = START
        with np.errstate(over="ignore"):
            pairs = mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens)
        self.uni, self.at_uni = np.unique(tokens, return_inverse=True)
        self.bi, self.at_bi = np.unique(pairs, return_inverse=True)
        self.training = np.repeat([is_training(i) for i in self.ids.tolist()], self.n_tokens)
        self.first = np.zeros(len(tokens), bool)
        self.first[self.ends - self.n_tokens] = True

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the distinct keys of the block."""
        return tuple(np.bincount(at[self.training], minlength=len(k)).astype("<u4") for at, k in ((self.at_uni, self.uni), (self.at_bi, self.bi)))


def _send(parts: int):
    def run(block: int, payload: bytes) -> Iterator[pd.DataFrame]:
        t = Tokens(payload)
        a, b = t.counts()
        cuts, cuts2 = parts_of(t.uni, parts), parts_of(t.bi, parts)
        rows = []
        for p in range(parts):
            u, v = slice(cuts[p], cuts[p + 1]), slice(cuts2[p], cuts2[p + 1])
            rows.append((block, p, join_values(squeeze_keys(t.uni[u]), squeeze_array(a[u]), squeeze_keys(t.bi[v]), squeeze_array(b[v]))))
        yield pd.DataFrame(rows, columns=["block", "part", "payload"])

    return run


def _count(x: pd.DataFrame) -> pd.DataFrame:
    """Sum the counts of equal keys over all blocks, and answer each block in its order."""
    sent = [split_values(p) for p in x["payload"]]
    answers, stats = [], {}
    for k, name in ((0, "uni"), (2, "bi")):
        keys = [unsqueeze_keys(s[k]) for s in sent]
        n = [unsqueeze_array(s[k + 1], "<u4") for s in sent]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(n), minlength=len(distinct)).astype("<u8")
        stats[name] = [int((total > 0).sum()), int(total.sum())]
        answers.append(np.split(total[at], np.cumsum([len(i) for i in keys])[:-1]))
    rows = [(b, p, join_values(squeeze_array(u), squeeze_array(v))) for b, p, u, v in zip(x["block"], x["part"], *answers, strict=True)]
    rows.append((-1, x["part"].iloc[0], json.dumps(stats).encode()))
    return pd.DataFrame(rows, columns=["block", "part", "payload"])


def _answered(t: Tokens, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: counts of its bigram, of its context and of itself."""
    got = [split_values(answers[p]) for p in sorted(answers)]
    uni = np.concatenate([unsqueeze_array(g[0], "<u8") for g in got]).astype(np.float64)
    bi = np.concatenate([unsqueeze_array(g[1], "<u8") for g in got]).astype(np.float64)
    c1 = uni[t.at_uni]
    context = np.empty_like(c1)
    context[1:] = c1[:-1]
    context[t.first] = uni[np.searchsorted(t.uni, END)]  # as many starts as ends
    return bi[t.at_bi], context, c1


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1))).astype(np.int64)


def _level(p: np.ndarray) -> np.ndarray:
    """The step of a probability; 0 stands for none."""
    return np.where(p > 0, np.clip(np.rint(-np.log2(np.maximum(p, 1e-300)) * STEPS), 0, LEVELS - 2) + 1, 0).astype(np.int64)


def _histogram(total: int):
    def run(block: int, payload: bytes, answers: dict[int, bytes]) -> pd.DataFrame:
        t = Tokens(payload)
        c2, cv, c1 = (x[t.training] - 1 for x in _answered(t, answers))  # each without itself
        p2 = c2 / np.maximum(cv, 1)
        cells = (_bucket(cv) * LEVELS + _level(p2)) * LEVELS + _level(c1 / max(total - 1, 1))
        cells, n = np.unique(cells, return_counts=True)
        return pd.DataFrame({"cell": cells, "n": n})

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, p0: float) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, unigram and uniform, by expectation maximisation in each bucket."""
    if not len(cells):
        return np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    bucket, p2, p1 = cells // LEVELS**2, cells // LEVELS % LEVELS, cells % LEVELS
    p = np.stack([np.where(x > 0, 2.0 ** (-(x - 1) / STEPS), 0.0) for x in (p2, p1)] + [np.full(len(cells), p0)], 1)
    w = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    w[0] = [0.0, 0.9, 0.1]  # a context never seen predicts nothing
    for _ in range(ROUNDS):
        share = w[bucket] * p
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        got = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], 1)
        got += np.array([0.0, 0.6, 0.1]) * 1e-3 + 1e-6 * (np.arange(3) == 2)  # some weight is always left for the uniform
        got[0, 0] = 0
        w = got / got.sum(1, keepdims=True)
    return w


def _score(total: int, distinct: int, weights: np.ndarray):
    def run(block: int, payload: bytes, answers: dict[int, bytes]) -> pd.DataFrame:
        t = Tokens(payload)
        c2, cv, c1 = _answered(t, answers)
        w = weights[_bucket(cv)]
        p = w[:, 0] * c2 / np.maximum(cv, 1) + w[:, 1] * c1 / max(total, 1) + w[:, 2] / (distinct + 1)
        begin = t.ends - t.n_tokens
        sums = lambda x: np.add.reduceat(x, begin)
        base = np.log10((c1 + 0.1) / (total + 0.1 * (distinct + 1)))
        return pd.DataFrame({"doc_id": t.ids, "n_tokens": t.n_tokens, "n_known": sums((c1 > 0).astype(np.int64)), "base_score": sums(base), "score": sums(np.log10(p))})

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents (doc_id, text).

    Learned from rows whose crc32(doc_id as text) mod 10 is not 0. A null or empty text is one end token;
    repeated rows count and are scored one by one; a null doc_id counts as training; other columns are left
    out; an empty table gives an empty result.
    """
    blocks = to_blocks(docs)
    parts = parts_for(blocks)
    sent = map_blocks(blocks, _send(parts), PART_SCHEMA)
    answers = save(at_parts(sent, _count, PART_SCHEMA), "counts", "none")
    stats = [json.loads(bytes(r.payload)) for r in answers.where("block = -1").select("payload").collect()]
    distinct, total = (sum(s["uni"][k] for s in stats) for k in (0, 1))
    answers = answers.where("block >= 0")
    cells = with_answers(blocks, answers, _histogram(total), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = learn_weights(cells["cell"].to_numpy().astype(np.int64), cells["n"].to_numpy(), 1 / (distinct + 1))
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    out = with_answers(blocks, answers, _score(total, distinct, weights), schema)
    key = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    held = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return out.select(key.alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
