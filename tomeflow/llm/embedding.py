"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors go to the shards of their nearest centroids, several each, so that shards overlap. Each shard builds a
robust-pruned graph of its own; the adjacency lists of a vector are united over its shards. Then every vector
searches: greedily from the shard's medoid, and once in range it expands everything in range. Links are
verified in double precision and counted in the first shard that both ends share. Recall is audited against
brute force on a bounded set of queries; where it falls short, shards overlap more and beams widen.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save
from .components import components

#: Rows the centroids are fitted on, centroids, and rows a shard should have.
SAMPLE_ROWS, MOST_CENTROIDS, SHARD_ROWS = 20_000, 1_024, 400
#: Rows of a task: larger shards are cut into pieces, and each two pieces meet in a task.
PIECE_ROWS = 700
DEGREE, ALPHA = 16, 1.2
NO_ID = -(1 << 61)
#: (shards of a vector, beam) tried in turn until the audit is met.
SETTINGS = ((3, 24), (6, 64), (12, 160))
#: Recall that ends the tries, and below which there is no result.
AUDIT_QUERIES, RECALL, LEAST_RECALL = 512, 0.97, 0.9
log = logging.getLogger(__name__)
#: How far below the threshold a neighbour still is expanded, in cosine.
RANGE_SLACK = 0.06


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of unit vectors, from evenly spaced rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    c = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].copy()
    for _ in range(6):
        own = np.concatenate([(x @ c.T).argmax(1) for x in np.array_split(sample, -(-len(sample) // 4096))])
        new = np.zeros_like(c)
        np.add.at(new, own, sample)
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 0, new / np.maximum(norm, 1e-300), c)
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency of unit vectors: near neighbours, less those that a kept neighbour is alpha times nearer to."""
    n = len(x)
    near = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0))
    np.fill_diagonal(near, np.inf)
    m = min(n - 1, 4 * degree)
    out: list[list[int]] = [[] for _ in range(n)]
    if m <= 0:
        return [np.zeros(0, np.int64) for _ in out]
    cand = np.argpartition(near, m - 1, axis=1)[:, :m]
    cand = np.take_along_axis(cand, np.argsort(np.take_along_axis(near, cand, 1), axis=1, kind="stable"), 1)
    alive = np.ones((n, m), bool)
    rows = np.arange(n)
    for _ in range(degree):
        pick = alive.argmax(1)
        has = alive[rows, pick]
        if not has.any():
            break
        p = cand[rows, pick]
        for i in np.flatnonzero(has).tolist():
            out[i].append(int(p[i]))
        alive &= ~(has[:, None] & (alpha * near[p[:, None], cand] <= near[rows[:, None], cand]))
        alive[rows, pick] = False
    back: list[list[int]] = [[] for _ in range(n)]
    for i, js in enumerate(out):
        for j in js:
            back[j].append(i)
    # Edges both ways, the reverse ones bounded too, and a ring that keeps the graph in one piece.
    return [np.unique(np.array(out[i] + sorted(back[i], key=lambda j, i=i: near[i, j])[: 2 * degree] + [(i + 1) % n], np.int64)) for i in range(n)]


def range_search(x: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """(queries, rows) bool: rows found within the threshold, by greedy search from the medoid."""
    n = len(x)
    width = max(1, max((len(g) for g in graph), default=1))
    table = np.full((n + 1, width), n)
    for i, g in enumerate(graph):
        table[i, : len(g)] = g
    padded = np.vstack([x, np.zeros(x.shape[1])])
    mean = x.mean(0)
    medoid = int((x @ mean).argmax())
    score = np.full((len(queries), n + 1), -np.inf)  # of what has been seen
    todo = np.full((len(queries), n + 1), -np.inf)  # of what has been seen and not expanded
    score[:, medoid] = todo[:, medoid] = x[queries] @ x[medoid]
    active = np.arange(len(queries))
    low = threshold - RANGE_SLACK
    while len(active):
        best = todo[active].argmax(1)
        value = todo[active, best]
        s = score[active]
        worst = np.partition(s, s.shape[1] - min(beam, n), axis=1)[:, s.shape[1] - min(beam, n)]
        go = (value > -np.inf) & ((value >= low) | (value >= worst))
        active, best = active[go], best[go]
        if not len(active):
            break
        todo[active, best] = -np.inf
        near = table[best]
        sims = np.einsum("qd,qkd->qk", padded[queries[active]], padded[near])
        new = (score[active[:, None], near] == -np.inf) & (near < n)
        r, c = np.nonzero(new)
        score[active[r], near[r, c]] = todo[active[r], near[r, c]] = sims[r, c]
    return score[:, :n] >= threshold


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vec: str, label: str):
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vec).isNotNull() & F.col(label).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda v: v != 0)


def _assign(centers: np.ndarray, most: int):
    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        out = []
        for x in v:
            if len(x) != centers.shape[1]:
                out.append([0])
                continue
            x = np.asarray(x, np.float64)
            out.append(np.sort(np.argsort(-(centers @ x), kind="stable")[:most]).tolist())
        return pd.Series(out)

    return run


def _tasks(points: DataFrame) -> DataFrame:
    """Rows of (label, dim, shard) dealt to tasks of two pieces (i <= j) of at most about PIECE_ROWS rows each."""
    x = points.withColumn("shard", F.explode("shards"))
    size = x.groupBy("label", "dim", "shard").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PIECE_ROWS)).cast("int").alias("pieces"))
    x = x.join(size, ["label", "dim", "shard"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return x.withColumn("i", F.least("piece", "other")).withColumn("j", F.greatest("piece", "other"))


def _build(x: pd.DataFrame) -> pd.DataFrame:
    graph = robust_prune(_unit(x["vector"]))
    ids = x["id"].to_numpy()
    return pd.DataFrame({"id": ids, "near": [ids[g] for g in graph]})


def _search(threshold: float, beam: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id", ignore_index=True)
        v, ids, weight = _unit(x["vector"]), x["id"].to_numpy(), x["weight"].to_numpy()
        place = {k: i for i, k in enumerate(ids.tolist())}
        graph = [np.array([place[k] for k in near if k in place], np.int64) for near in x["near"]]
        n, hits = len(x), []
        for q in np.array_split(np.arange(n), -(-n // 512)):
            hits.append(range_search(v, graph, q, threshold, beam))
        found = np.vstack(hits)
        found |= found.T
        np.fill_diagonal(found, False)
        r, c = np.nonzero(found)
        for k in range(0, len(r), 1 << 16):  # verified: what the searches returned, pair by pair
            p, q = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            found[p, q] = np.einsum("ij,ij->i", v[p], v[q]) >= threshold
        if int(x["i"].iloc[0]) != int(x["j"].iloc[0]):
            found &= x["piece"].to_numpy()[:, None] != x["piece"].to_numpy()[None, :]
        # Counted where both ends first meet.
        shard = int(x["shard"].iloc[0])
        before = [[s for s in row if s < shard] for row in x["shards"]]
        col = {s: k for k, s in enumerate(sorted({s for row in before for s in row}))}
        member = np.zeros((n, len(col) + 1), np.float32)
        for i, row in enumerate(before):
            member[i, [col[s] for s in row]] = 1
        found_here = found & (member @ member.T == 0)
        links = (found_here * weight[None, :]).sum(1)
        root = np.arange(n)
        while True:
            new = np.minimum(root, np.where(found, root[None, :], n).min(1, initial=n))
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"id": ids, "links": links.astype(np.int64), "points": found_here.sum(1), "root": ids[root]})

    return run


def _audit(points: DataFrame, counts: DataFrame, threshold: float) -> float:
    """Recall of a bounded set of queries against all rows in blocks: the mean over queries with links of the share
    of linked points that were found, so that a large family counts no more than a pair."""
    q = points.orderBy(F.xxhash64(F.lit("audit"), "id")).limit(AUDIT_QUERIES).select("id", "label", "vector").toArrow().to_pylist()
    if not q:
        return 1.0
    by: dict = {}
    for r in q:
        by.setdefault((str(r["label"]), len(r["vector"])), []).append(r)
    by = {k: (_unit([r["vector"] for r in rows]), np.array([r["id"] for r in rows])) for k, rows in by.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            dims = f["vector"].map(len)
            for (label, dim), g in f.groupby([f["label"].astype(str), dims]):
                if (label, dim) in by:
                    qv, qid = by[label, dim]
                    hit = (qv @ _unit(g["vector"]).T >= threshold) & (qid[:, None] != g["id"].to_numpy()[None, :])
                    yield pd.DataFrame({"id": qid, "true": hit.sum(1)})

    true = points.select("id", F.col("label").cast("string").alias("label"), "vector").mapInPandas(run, "id long, true long")
    true = true.groupBy("id").agg(F.sum("true").alias("true"))
    r = true.where(F.col("true") > 0).join(counts, "id", "left").agg(F.avg(F.coalesce("points", F.lit(0)) / F.col("true")).alias("recall")).first()
    return 1.0 if r.recall is None else r.recall


def near_vectors(vectors: DataFrame, threshold: float = 0.93, settings=SETTINGS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label).

    Vectors link if their labels are equal, and not null, and their cosine is at least the threshold. A vector
    that is null, empty, zero or has a null or non-finite component links with nothing, nor do vectors of
    different lengths. Equal vectors of a label are one point with a weight. Other columns are left out; an
    empty table gives an empty result. Rows with null vec_ids count and stand before all others; where one is the
    smallest of a component, its component_id is null.
    """
    # Without an id a vector goes by a negative number made of its value, below NO_ID.
    no_id = F.lit(2 * NO_ID) + F.pmod(F.xxhash64("label", "embedding"), F.lit(-NO_ID))
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), no_id).alias("vec_id"), "label", F.col("embedding").alias("vector"))
    rows = rows.withColumn("ok", _valid("vector", "label"))
    points = rows.where("ok").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    points = save(points.withColumn("dim", F.size("vector")), "points")
    n = points.count()
    part = min(1.0, SAMPLE_ROWS / max(1, n))
    dim = points.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    picked = points.where((F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(part * (1 << 30))) & (F.col("dim") == (dim.dim if dim else 0)))
    sample = picked.orderBy("id").limit(2 * SAMPLE_ROWS).select("vector").toArrow()["vector"].to_pylist()
    centers = centroids(_unit(sample) if sample else np.zeros((0, 1)), min(MOST_CENTROIDS, -(-n // SHARD_ROWS) or 1))
    counts = None
    for most, beam in settings:
        tasks = save(_tasks(points.withColumn("shards", _assign(centers, most)("vector"))), "shards")
        keys = ["label", "dim", "shard", "i", "j"]
        edges = tasks.groupBy(*keys).applyInPandas(_build, "id long, near array<long>")
        near = edges.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
        found = tasks.join(near, "id").groupBy(*keys).applyInPandas(_search(threshold, beam), "id long, links long, points long, root long")
        found = save(found, "found")
        counts = save(found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("points").alias("points")), "counts")
        recall = _audit(points, counts, threshold)
        discard(tasks)
        log.info("recall %.4f with %d shards a vector, beam %d", recall, most, beam)
        if recall >= RECALL:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"recall {recall:.3f} falls short with the widest setting")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = points.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    linked = rows.where("ok").join(classes, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    known = lambda c: F.when(F.col(c) >= NO_ID, F.col(c))
    out = linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return out.select(known("vec_id").alias("vec_id"), "n_links", known("component_id").alias("component_id"), "kept")
