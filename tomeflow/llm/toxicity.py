"""Toxicity by misspelling-tolerant lexicon matches in context.

The lexicon (whole terms and stems) is learned from labelled rows, laid into a trie, and intersected with a
Levenshtein automaton: a state is the set of (trie node, errors left) that a word's prefix can be at, made on
demand and kept, so a word costs a step for each character and most words die early. Each match is weighed by
its kind and by its window of context, which separates quotation from use; weights are learned too.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_fold, discard, free_memory, save, tidy

#: Bounds of the sample of labelled rows that lexicon and weights are fitted on, by label.
MOST_TOXIC, MOST_CLEAN = 8_000, 16_000
#: A term is learned from this many distinct toxic texts at least, of which toxic ones, with labels balanced, make this share.
LEAST_ROWS, PRECISION, MOST_TERMS = 4, 0.97, 4_000
STEM_LENGTHS = range(4, 9)
#: Contexts of its own a term needs (see _support), and their share of its texts: edited copies reach the first by number.
LEAST_SUPPORT, OWN_SHARE = 3, 0.01
#: Terms of so many characters tolerate one error.
FUZZY_LENGTH = 5
WINDOW = 6
KINDS = ("exact", "stem", "fuzzy")
CONTEXTS = ("plain", "quoted")
MOST_COUNT = 3
#: Words whose match a worker keeps; characters of a text that are parted into words together.
MOST_KNOWN, STRETCH = 200_000, 1_000_000
#: Signs of quotation or report in a window.
QUOTES = "\"“”„«»‹›"
REPORT = frozenset("said says called quote quoted quoting word term slur insult sagte nannte wort zitat dit appelle mot dijo llama palabra".split())
_EDGE = re.compile(r"^\W+|\W+$")


def normal(word: str) -> str:
    return _EDGE.sub("", word.lower())


class LexiconAutomaton:
    """match(word): the kind of its best match with the lexicon (0 exact, 1 stem, 2 one error), or -1.

    A state is kept as a sorted array of 2 * node + errors left; states are made anew when there are too many.
    """

    MOST_STATES = 40_000

    def __init__(self, terms: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.term, self.stem, self.fuzzy = set(), set(), set()
        for words, marks in ((terms, self.term), (stems, self.stem)):
            for w in words:
                node = 0
                for c in w:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                    node = self.next[node][c]
                marks.add(node)
                if marks is self.term and len(w) >= FUZZY_LENGTH:
                    self.fuzzy.add(node)
        self.chars = {c for n in self.next for c in n}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[bytes, int] = {}
        self.sets: list[bytes] = []
        self.steps: list[dict[str, int]] = []
        self.kind: list[int] = []
        self.start = self._state(self._close({(0, 1)}))

    def _close(self, at: set) -> set:
        """at with what a character missing from the word leads to; without what is reached with fewer errors."""
        for node, left in list(at):
            if left:
                at.update((n, left - 1) for n in self.next[node].values())
        return {(n, e) for n, e in at if e == 1 or (n, 1) not in at}

    def _state(self, s: set) -> int:
        name = array("i", sorted(2 * n + e for n, e in s)).tobytes()
        if name not in self.states:
            self.states[name] = len(self.sets)
            self.sets.append(name)
            self.steps.append({})
            exact = any(e == 1 and n in self.term for n, e in s)
            self.kind.append(0 if exact else 2 if any(n in self.fuzzy for n, e in s) else -1)
        return self.states[name]

    def _step(self, state: int, c: str) -> int:
        at = set()
        for x in array("i", self.sets[state]):
            node, left = x >> 1, x & 1
            if (n := self.next[node].get(c)) is not None:
                at.add((n, left))
            if left:
                at.add((node, 0))  # a character too many
                at.update((n, 0) for x, n in self.next[node].items() if x != c)  # another character
        return self._state(self._close(at)) if at else -1

    def match(self, word: str) -> int:
        if len(self.sets) > self.MOST_STATES:
            self._reset()
        state, node, stem = self.start, 0, False
        for c in word:
            if node is not None:
                node = self.next[node].get(c)
                stem = stem or node in self.stem
            c = c if c in self.chars else ""
            to = self.steps[state].get(c)
            if to is None:
                to = self.steps[state][c] = self._step(state, c)
            if to < 0:
                return 1 if stem else -1
            state = to
        kind = self.kind[state]
        return kind if kind == 0 or not stem else 1


@dataclass
class Model:
    """A lexicon of at most MOST_TERMS entries and a weight for each kind and context of match."""

    terms: list[str]
    stems: list[str]
    bias: float
    weights: list[float]


def _stretches(text: str) -> Iterator[tuple[list[str], int, int]]:
    """Words of a text in stretches of bounded length, with WINDOW words of their neighbours: (words, begin, end)."""
    if len(text) <= STRETCH:
        words = text.split()
        yield words, 0, len(words)
        return
    before: list[str] = []
    begin, now = 0, []
    while begin < len(text) or now:
        end = begin + STRETCH
        while end < len(text) and not text[end].isspace():
            end += 1
        new = text[begin:end].split()
        if now:
            yield before + now + new[:WINDOW], len(before), len(before) + len(now)
            before = (before + now)[-WINDOW:]
        begin, now = end, new


def features(text: str, automaton: LexiconAutomaton, known: dict[str, int]) -> list[int]:
    """Matches by kind and context, each counted up to MOST_COUNT."""
    out = [0] * (len(KINDS) * len(CONTEXTS))
    for words, begin, end in _stretches(text):
        for i in range(begin, end):
            w = words[i]
            k = known.get(w)
            if k is None:
                if len(known) > MOST_KNOWN:
                    known.clear()
                k = known[w] = automaton.match(normal(w))
            if k < 0:
                continue
            window = words[max(0, i - WINDOW) : i + WINDOW + 1]
            opened = any(q in x for x in words[max(0, i - WINDOW) : i + 1] for q in QUOTES)
            closed = any(q in x for x in words[i : i + WINDOW + 1] for q in QUOTES)
            quoted = (opened and closed) or any(normal(x) in REPORT for x in window)
            j = 2 * k + quoted
            out[j] = min(MOST_COUNT, out[j] + 1)
    return out


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample of labelled training texts: the first of each label in hashed order, copies counted once."""
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold("doc_id", 5) != 0))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    order = F.xxhash64(F.lit("toxic"), "doc_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = texts.select("doc_id", F.xxhash64("text").alias("h")).join(ids, "doc_id").groupBy("y", "h").agg(F.min(F.struct(order.alias("o"), "doc_id")).alias("m"))
    first = first.select("m.doc_id", "y", "m.o")
    picked = first.where("y = 1").orderBy("o", "doc_id").limit(MOST_TOXIC).union(first.where("y = 0").orderBy("o", "doc_id").limit(MOST_CLEAN)).drop("o").distinct()
    fit = F.when(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(4)) == 0, 1).otherwise(0)  # of weights, not of terms
    return texts.join(F.broadcast(picked.withColumn("fit", fit)), "doc_id").groupBy("y", "text").agg(F.min("fit").alias("fit"))


def _candidates(text: str) -> set[str]:
    """Terms of a text, and stems as term*."""
    words = {normal(w) for w in text.split()}
    out = {w for w in words if len(w) >= 3}
    for w in words:
        out.update(w[:n] + "*" for n in STEM_LENGTHS if n < len(w))
    return out


def _counts(sample: DataFrame, only: frozenset | None, least: int) -> dict[str, int]:
    """Texts that have each candidate term; sample has none twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for f in frames:
            n: Counter = Counter()
            for t in f["text"]:
                c = _candidates(t)
                n.update(c if only is None else c & only)
                if len(n) > MOST_KNOWN:  # counts are summed after the exchange, so they may leave in parts
                    yield pd.DataFrame({"term": list(n.keys()), "n": list(n.values())})
                    n.clear()
            yield pd.DataFrame({"term": list(n.keys()), "n": list(n.values())})

    rows = sample.select("text").mapInPandas(tidy(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = rows.where(F.col("n") >= least).toArrow().to_pydict()
    return dict(zip(got["term"], got["n"], strict=True))


def _support(sample: DataFrame, only: frozenset) -> dict[str, int]:
    """Contexts (two words before and two after) of each term that share at most one word, at its place, with its
    most frequent context.

    A term of one text that was copied, with or without edits, has next to none; a term in use has many, also
    where the same word always stands before it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list = []
            for t in f["text"]:
                words = ["", "", *(normal(w) for w in t.split()), "", ""]
                found = set()
                for i in range(2, len(words) - 2):
                    w = words[i]
                    for c in (w, *(w[:n] + "*" for n in STEM_LENGTHS if n < len(w))):
                        if c in only:
                            found.add((c, words[i - 2], words[i - 1], words[i + 1], words[i + 2]))
                rows += found
            yield pd.DataFrame(rows, columns=["term", "c0", "c1", "c2", "c3"], dtype=object)

    at = ["c0", "c1", "c2", "c3"]
    rows = sample.select("text").mapInPandas(tidy(run), "term string, c0 string, c1 string, c2 string, c3 string").groupBy("term", *at).agg(F.count("*").alias("n"))
    most = rows.groupBy("term").agg(F.max_by(F.struct(*at), F.struct("n", *at)).alias("m"))
    same = sum((F.col(c) == F.col(f"m.{c}")).cast("int") for c in at)
    other = rows.join(most, "term").where(same <= 1).groupBy("term").agg(F.count("*").alias("k"))
    got = other.toArrow().to_pydict()  # a row for each candidate term of a bounded sample
    return dict(zip(got["term"], got["k"], strict=True))


def _precise(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, int]:
    """The candidates with the asked precision."""
    good = {}
    for t, n in toxic.items():
        a, b = n / max(1, n_toxic), (clean.get(t, 0) + 0.5) / max(1, n_clean)
        if a / (a + b) >= PRECISION:
            good[t] = n
    return good


def _choose(good: dict[str, int]) -> tuple[list[str], list[str]]:
    """Terms and stems; the shortest stem stands for those that it begins."""
    stems: list[str] = []
    for s in sorted((t[:-1] for t in good if t.endswith("*")), key=lambda s: (len(s), s)):
        if not any(s.startswith(x) for x in stems):
            stems.append(s)
    # A stem that only one term continues is that term.
    words = [t for t in good if not t.endswith("*")]
    stems = [s for s in stems if (kin := [w for w in words if w.startswith(s)]) != [] and good[s + "*"] > 1.2 * max(good[w] for w in kin) or not kin]
    best = sorted(words, key=lambda t: (-good[t], t))[: MOST_TERMS // 2]
    return sorted(best), sorted(stems, key=lambda s: (-good[s + "*"], s))[: MOST_TERMS // 2]


def _fit_weights(cells: list[tuple[list[int], int, int]]) -> tuple[float, list[float]]:
    """Logistic regression with a ridge, by Newton steps, on counted cells (features, label, rows)."""
    d = len(KINDS) * len(CONTEXTS)
    x = np.array([[1.0, *c[0]] for c in cells] or np.zeros((0, d + 1)))
    y, n = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    prior = np.array([-3.0] + [4.0, 1.0, 3.5, 0.8, 2.5, 0.5])  # without rows, what matches of each kind suggest
    w = prior.copy()
    ridge = np.diag([0.01] + [0.5] * d)
    loss = lambda v: float(n @ (np.logaddexp(0, x @ v) - y * (x @ v)) + (v - prior) @ ridge @ (v - prior) / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (n * (p - y)) + ridge @ (w - prior)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge
        step, now, part = np.linalg.solve(hess, grad), loss(w), 1.0
        while part > 1e-6 and loss(w - part * step) > now:  # a whole step may overshoot where labels part well
            part /= 2
        if part <= 1e-6 or np.abs(part * step).max() < 1e-8:
            break
        w = w - part * step
    return float(w[0]), [float(v) for v in w[1:]]


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights from labelled rows outside the held-out fold (crc32 of the id mod 5 is 0).

    The distinct texts used are bounded by MOST_TOXIC and MOST_CLEAN; three quarters give terms, the rest weights.
    Copies of a text count once.
    Without labelled rows the lexicon is empty and every text gets the same low score.
    """
    bound_batches(docs.sparkSession)
    sample = save(_sample(docs, labels), "toxic")
    size = {(r.y, r.fit): r["count"] for r in sample.groupBy("y", "fit").count().collect()}
    toxic = _counts(sample.where("y = 1 and fit = 0"), None, LEAST_ROWS)
    clean = _counts(sample.where("y = 0 and fit = 0"), frozenset(toxic), 1)
    good = _precise(toxic, clean, size.get((1, 0), 0), size.get((0, 0), 0))
    support = _support(sample.where("y = 1 and fit = 0"), frozenset(good)) if good else {}
    terms, stems = _choose({t: n for t, n in good.items() if support.get(t, 0) >= max(LEAST_SUPPORT, OWN_SHARE * n)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, known = LexiconAutomaton(terms, stems), {}
        for f in frames:
            yield pd.DataFrame({"x": [features(t, automaton, known) for t in f["text"]], "y": f["y"]})

    cells = sample.where("fit = 1").select("text", "y").mapInPandas(tidy(run), "x array<int>, y int").groupBy("x", "y").count().collect()
    discard(sample)
    bias, weights = _fit_weights(sorted((list(r.x), r.y, r["count"]) for r in cells))
    return Model(terms, stems, bias, weights)


def score_column(model: Model):
    """A function of a text column that gives the score of each whole text; only texts go to Python."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, known, done = LexiconAutomaton(model.terms, model.stems), {}, {}
        for texts in batches:
            out = []
            for t in texts:
                x = tuple(features(t or "", automaton, known))
                if x not in done:
                    done[x] = 1 / (1 + math.exp(-model.bias - sum(a * b for a, b in zip(model.weights, x, strict=True))))
                out.append(done[x])
            yield pd.Series(out, dtype="float64")
        free_memory()

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of documents (doc_id, text), learned from labels (doc_id, toxic).

    Null and empty texts score as texts without matches do; repeated rows are scored alike.
    """
    out = docs.select("doc_id", score_column(learn(docs, labels))(F.col("text")).alias("score"))
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without rows that score 0.5 or more."""
    scored = docs.withColumn("__toxicity", score_column(learn(docs, labels))(F.col("text")))
    return scored.where("__toxicity < 0.5").select(*docs.columns)
