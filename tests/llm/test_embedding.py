import numpy as np
import pandas as pd
import pytest
from brute import components

from tomeflow.llm import embedding, queries


def brute(rows, threshold=0.93):
    """{vec_id: (links, component)}"""
    by = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and None not in v and np.isfinite(v).all() and any(v):
            by.setdefault((label, len(v)), []).append((i, v))
    n, links = {i: 0 for i, _, _ in rows}, []
    for group in by.values():
        x = np.array([v for _, v in group], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(np.triu(x @ x.T >= threshold, 1)):
            i, j = group[a][0], group[b][0]
            n[i], n[j] = n[i] + 1, n[j] + 1
            links.append((i, j))
    comp = components(n, links)
    return {i: (n[i], comp[i]) for i in n}


def check(got, want, least):
    got = {r.vec_id: (r.n_links, r.component_id) for r in got.itertuples() if r.kept == (r.vec_id == r.component_id)}
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= least * sum(v[0] for v in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) >= least


def test_embeddings(spark):
    rows = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in rows.itertuples()]
    check(queries.op4_embedding_dedup(spark, "/root/testdata/sf0.01").toPandas(), brute(rows), 0.97)


@pytest.mark.parametrize("piece", [700, 25])
def test_large_groups(spark, monkeypatch, piece):
    """A family in which all link, copies, and shards that are cut."""
    monkeypatch.setattr(embedding, "PIECE_ROWS", piece)
    monkeypatch.setattr(embedding, "SHARD_ROWS", 40)
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    x = np.concatenate([base + 0.1 * rng.normal(size=(90, 16)), rng.normal(size=(90, 16)), rng.normal(size=(10, 16)).repeat(3, 0) + 0.15 * rng.normal(size=(30, 16))])
    x[5] = x[6] = x[7]
    rows = [(1000 - i, [float(a) for a in np.float32(v)], i % 2 if i < 20 else 1) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    check(embedding.near_vectors(frame).toPandas(), brute(rows), 0.97)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1),
        (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [2.0, 0.0], 2), (12, [4.0, 0.01], 1),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, shard string")
    check(embedding.near_vectors(frame).toPandas(), brute(rows), 1.0)
    assert embedding.near_vectors(frame.limit(0)).count() == 0


def test_null_ids_and_extreme_vectors(spark):
    rows = [(None, [1e200, 1e200], 1), (3, [1e200, 1.01e200], 1), (4, [1e-200, 1e-200], 1), (None, [1.0, -1.0], 1), (None, None, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding.near_vectors(frame).collect()))
    assert got == [(0, 0, 0, True), (0, 0, 0, True), (0, 2, 0, True), (3, 2, 0, False), (4, 2, 0, False)]
