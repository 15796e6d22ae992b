import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from brute import WORD, components as plain_components, fold, jaccard as plain_jaccard, lower, suffix_dedup as plain_dedup

from tomeflow.llm import jaccard, lm, queries, suffixdedup
from tomeflow.llm.blocks import block_words
from tomeflow.llm.components import components
from tomeflow.llm.suffixsort import deep_shallow

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string")


def documents(sf=SF):
    return list(map(tuple, pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "text"]].to_numpy()))


def made_texts(seed=3):
    """Families of near copies, shared passages, short and odd texts."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, out = text(60), []
    for n in (12, 40, 100, 300):
        base = text(n)
        for k in range(14):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, n // 12))):
                t[rng.randrange(n)] = rng.choice(words)
            out.append(" ".join(t))
    for _ in range(12):
        t = text(80)
        at = rng.randrange(80)
        out.append(" ".join(t[:at] + passage + t[at:]))
    out += ["a b c d e f g h i " * 40, "aaaa" * 100, "aaaa" * 60, "é" * 120, "x", "X", "x y", "x  Y", "", "  \n", "one two three", out[5].upper(), out[5], out[5]]
    rng.shuffle(out)
    return [(100 + 3 * i, t) for i, t in enumerate(out)] + [(7, None)]


def test_words():
    rows = [t.encode() for _, t in made_texts() if t] + ["É a\x0bB".encode()]
    h, n = block_words(np.array([len(r) for r in rows]), np.frombuffer(b"".join(rows), np.uint8))
    plain = [WORD.findall(lower(r.decode())) for r in rows]
    assert n.tolist() == [len(p) for p in plain]
    by = {}
    for w, x in zip((w for p in plain for w in p), h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_deep_shallow():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (400, 60)).astype(np.uint8)
    rows[100:300, :50] = rows[100, :50]
    rows[200:250] = rows[200]
    groups = rng.integers(0, 4, 400)
    order, lcp = deep_shallow(groups, rows)
    got = [(int(groups[i]), rows[i].tobytes()) for i in order]
    assert got == sorted((int(g), r.tobytes()) for g, r in zip(groups, rows))
    for j in range(1, 400):
        (g, a), (h, b) = got[j - 1], got[j]
        want = -1 if g != h else next((k for k in range(60) if a[k] != b[k]), 60)
        assert lcp[j] == want


@pytest.mark.parametrize("which", ["made", "sf"])
def test_suffix_dedup(spark, which):
    rows = made_texts() if which == "made" else documents()
    got = suffixdedup.dedup_texts(frame(spark, rows).repartition(3), 100)
    import hashlib

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got.collect()}
    want = plain_dedup(rows)
    assert {d: v for d, v in got.items() if v != want[d]} == {} and len(got) == len(want)


def test_suffix_dedup_odd_rows(spark):
    t = " ".join(map(str, range(100)))
    rows = [(None, t), (1, t), (1, t), (2, t[:99]), (3, "")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffixdedup.dedup_texts(frame(spark, rows), 100).collect())
    assert got == [(0, 0), (1, len(t)), (1, len(t)), (2, 0), (3, 0)]
    assert suffixdedup.dedup_texts(frame(spark, []), 100).count() == 0


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("which", ["made", "sf"])
def test_jaccard(spark, words, num, den, which, monkeypatch):
    if which == "made":  # small regions, so that each way of joining them is taken
        for name, value in (("LEAF", 2), ("GROUP", 5), ("MOST_LEVELS", 2), ("MOST_PIECES", 1 if words == 3 else 3), ("MOST_MARKED", 0 if words == 3 else 1 << 28)):
            monkeypatch.setattr(jaccard, name, value)
    rows = made_texts() if which == "made" else documents()
    got = jaccard.jaccard_join(frame(spark, rows).repartition(3), words, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    want = plain_jaccard(rows, words, num, den)
    assert {d: (v, want[d]) for d, v in got.items() if v != want[d]} == {} and len(got) == len(want)


def test_signatures_meet():
    """Sets that link have a region in common, at every size, however they differ."""
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100)):
        for n in [*range(1, 60), *rng.integers(60, 900, 60).tolist()]:
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            lose = rng.integers(0, n + 1)
            for _ in range(3):
                # as different as a link allows
                gone, new = rng.integers(0, lose + 1), rng.integers(0, n + 1)
                while den * (n - gone) < num * (n + new):
                    gone, new = gone // 2 if new < gone else gone, new // 2 if new >= gone else new
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 64, new, np.uint64)]))
                for family in (0, 1):
                    assert np.intersect1d(jaccard.set_signatures(a, num, den, family), jaccard.set_signatures(b, num, den, family)).size


def test_jaccard_split_regions_of_two(spark, monkeypatch):
    """Texts of one template: some linked pairs share only regions that are split, and then meet alone."""
    monkeypatch.setattr(jaccard, "LEAF", 2)
    monkeypatch.setattr(jaccard, "GROUP", 5)
    monkeypatch.setattr(jaccard, "MOST_PIECES", 1)
    rows = []
    for i in range(80):
        text = f"we sell the best goods in the whole {i}p {i}q {i}r {i}s"
        rows += [(2 * i, text), (2 * i + 1, f"{text} {i}t")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(frame(spark, rows)).collect()}
    assert got == plain_jaccard(rows, 3, 90, 100)
    assert {c for _, c in got.values()} == set(range(0, 160, 2))


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (5, ""), (6, None), (9, "Z z"), (8, "z Z")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_join(frame(spark, rows)).collect())
    assert got == [(0, 2, 0), (4, 2, 0), (4, 2, 0), (5, 0, 5), (6, 0, 6), (8, 1, 8), (9, 1, 8)]
    assert jaccard.jaccard_join(frame(spark, [])).count() == 0


def test_jaccard_meets_in_regions_of_pivots(spark, caplog):
    """Of families of edited texts nearly all are joined in regions of pivots, and what keys add is logged apart."""
    rng = random.Random(6)
    rows = []
    for f in range(40):
        origin = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 300))]
        for k in range(8):
            text = list(origin)
            for _ in range(rng.randint(0, len(text) // 60)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(5000)}"
            rows.append((100 * f + k, " ".join(text)))
    with caplog.at_level("INFO", logger="tomeflow.llm.jaccard"):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(frame(spark, rows)).collect()}
    assert got == plain_jaccard(rows, 3, 90, 100)
    by_pivots, by_keys = map(int, re.findall(r"\d+", caplog.messages[-1]))
    joined = len({t for _, t in rows}) - len({c for _, c in got.values()})
    assert by_pivots + by_keys == joined and by_keys <= 0.05 * joined


def test_join_region():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 64, 100, np.uint64))
    sets = [base] + [np.unique(np.concatenate([rng.permutation(base)[k:], rng.integers(0, 1 << 64, k, np.uint64)])) for k in rng.integers(0, 14, 60)]
    links = [(i, j) for i in range(61) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))]
    for roots in (list(range(61)), [min(i, 3) for i in range(61)]):
        near = [1 - len(np.intersect1d(s, sets[9])) / len(np.union1d(s, sets[9])) for s in sets]
        known = [(i, r) for i, r in enumerate(roots)]
        got = jaccard.join_region(list(range(61)), sets, roots, near, 90, 100)
        assert plain_components(range(61), got + known) == plain_components(range(61), links + known)


def test_jaccard_sends_members_only_where_sets_may_link(spark, monkeypatch):
    """A region of 100 sets (cut into 1 or 3 pieces) that share a tenth, of which two link."""
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 63, 8).astype(np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 72).astype(np.uint64)])) for _ in range(99)]
    sets.append(sets[5][2:])
    made = [(i, len(s), s.astype("<u8").tobytes(), jaccard.sketch(s)) for i, s in enumerate(sets)]
    members = spark.createDataFrame(pd.DataFrame(made, columns=["id", "n", "members", "sketch"]), "id long, n long, members binary, sketch binary")
    x = members.selectExpr("1L AS region", "id", "n", "-1L AS pivot", "0D AS near")
    for group in (jaccard.GROUP, 40):
        monkeypatch.setattr(jaccard, "GROUP", group)
        sent, real = [], jaccard.save
        with monkeypatch.context() as m:
            m.setattr(jaccard, "save", lambda df, name, *a: (out := real(df, name, *a), sent.append(out.count()) if name == "left" else None)[0])
            links = jaccard._join_open(x, spark.createDataFrame([], "a long, b long"), members, 90, 100)
            assert {tuple(sorted(r)) for r in links.collect()} == {(5, 99)}
        assert sent == [2]


def test_jaccard_may_link():
    """Against all pairs: classes, pivots, distances not known, pieces, sets with cells of 255 members."""
    rng = np.random.default_rng(5)
    pool, linked, taken = rng.integers(0, 1 << 63, 60).astype(np.uint64), 0, []
    for trial in range(30):
        sets = [np.unique(rng.choice(pool, rng.integers(40, 60), replace=False)) for _ in range(40)]
        sets += [np.arange(k, 300 + k, dtype=np.uint64) for k in (0, 2, 200)]
        k = len(sets)
        x = pd.DataFrame({"id": np.arange(k) + 100, "n": [len(s) for s in sets], "root": rng.integers(0, 6, k), "near": rng.choice([0.0, 0.15, 0.4, np.nan], k), "pivot": rng.choice([100, 7], k), "sketch": [jaccard.sketch(s) for s in sets], "piece": rng.integers(0, 2, k), "i": 0, "j": trial % 2})
        want = np.zeros(k, bool)
        for a in range(k):
            for b in range(k):
                common = jaccard.overlap(sets[a], sets[b])
                links = 10 * common >= 7 * (len(sets[a]) + len(sets[b]) - common)
                far = abs(x["near"][a] - x["near"][b]) > 0.3 + 1e-6
                apart = x["root"][a] != x["root"][b] and not far and (x["id"] != x["pivot"])[[a, b]].all()
                if links and apart and (trial % 2 == 0 or x["piece"][a] != x["piece"][b]):
                    want[a] = True
        got = jaccard.may_link(x, 7, 10)
        assert got[want].all()
        linked += want.sum()
        taken += got.tolist()
    assert linked > 30 and not all(taken)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 1), (5, None)], "a long, b long")).collect()}
    want = plain_components({n for x in links for n in x}, links)
    assert got == {n: r for n, r in want.items() if any(n in x and x[0] != x[1] for x in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("which", ["made", "sf"])
def test_lm_scores(spark, which):
    rows = made_texts() if which == "made" else documents("/root/testdata/sf0.001")
    got = lm.score_documents(frame(spark, rows).repartition(3)).toPandas().set_index("doc_id")
    tokens = {d: WORD.findall(lower(t or "")) + [None] for d, t in rows}
    c = Counter(w for d, t in tokens.items() if fold(d, 10) for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows) and (got.train_tokens == n).all()
    for d, t in tokens.items():
        r = got.loc[d]
        assert r.held_out == (fold(d, 10) == 0) and (r.n_tokens, r.n_known) == (len(t), sum(c[w] > 0 for w in t))
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    held = got[got.held_out]
    assert np.isfinite(got.score).all() and held.score.sum() > held.base_score.sum() * 1.02


def test_lm_is_a_distribution():
    """With learned weights, what may follow a context sums to 1 with what was never seen."""
    rng = np.random.default_rng(0)
    cells = (rng.integers(1, 5, 200) * lm.LEVELS + rng.integers(0, 99, 200)) * lm.LEVELS + rng.integers(1, 99, 200)
    w = lm.learn_weights(cells, np.ones(200), 1e-3)
    assert np.allclose(w.sum(1), 1) and (w[:, 2] > 0).all() and w[0, 0] == 0


def test_lm_odd_rows(spark):
    got = lm.score_documents(frame(spark, [(None, "a b"), (1, None), (1, ""), (2, "a b")])).toPandas()
    assert sorted(got.n_tokens) == [1, 1, 3, 3] and np.isfinite(got.score).all()
    assert lm.score_documents(frame(spark, [])).count() == 0
