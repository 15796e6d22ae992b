"""Exact Jaccard join of word-shingle sets as a metric-space join, with the classes that its links form.

Jaccard distance is a metric, linked sets are no more than a radius apart. Pivots grow with the corpus: a set shows
MEETS of its shingles, the first of equal shares of the hash space; of the sets that show a shingle one becomes its
pivot, and a set meets the pivots that it shares two of them with. It lies in the Voronoi region of the nearest of
them, and, as a boundary set, in those that it is at most two radii farther from: linked sets lie together there.
Distances to the pivot give links at once, and by the triangle inequality two sets of a region can link only if
their distances to its pivot differ by no more than the radius. What this window leaves open is joined in turn:
small regions by their open pairs, larger ones around further pivots, those beyond GROUP after being split again,
and what can't be split in pieces that meet two by two. Sets already in one class need no comparison.

Linked sets nearly always share what they show (at a likeness of 0.8, two of 8 in all but 8 of 100,000 pairs), but
needn't. So the rest is found by keys that they must share: the shingle space is split by hash into more parts than
two linked sets can differ in, and those equal in a part are a region, whose pivot is the member that shares most
of them. Of these regions only those with sets of several classes are joined, in the same way.
"""

from __future__ import annotations

import functools
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_DOCS, NULL_ID, PART_SCHEMA, at_parts, block_words, join_values, map_blocks, mix, parts_for, parts_of, read_block, split_values, squeeze_array, squeeze_keys, to_blocks, unsqueeze_array, unsqueeze_keys
from .common import discard, free_heaps, free_memory, save, tidy
from .components import components

#: Bytes of texts in a block: a task holds one block's sets, and its compressed bytes stay small for the JVM.
BLOCK_BYTES = 1_000_000
#: Shingles that a set shows to meet pivots, a power of two; how many radii a pivot's region reaches.
MEETS, REACH = 8, 3
#: Open pairs of regions of up to LEAF sets are compared one by one, those of regions of up to GROUP sets (and
#: GROUP_SHINGLES shingles) in one task each, around further pivots; regions of up to MOST_PIECES times that are cut
#: into pieces that meet two by two, which copies a set once a piece. Splitting by keys copies it once a part, tens of
#: times, so only larger regions are split, up to MOST_LEVELS times, and what stays larger is cut into pieces too.
LEAF, GROUP, GROUP_SHINGLES = 64, 2048, 4_000_000
MOST_PIECES, MOST_LEVELS = 8, 3
#: Cells of a set's sketch; ids up to which a list of them is broadcast.
CELLS, MOST_BROADCAST = 256, 1_000_000
#: Rows of blocks up to which their bitmap is broadcast (32 MB); beyond, blocks are shuffled to it.
MOST_MARKED = 1 << 28
#: Rows of split regions that leave a worker together.
SPLIT_ROWS = 100_000
#: Keeps rounding from putting a set outside a window.
SLACK = 1e-6

log = logging.getLogger(__name__)


@functools.lru_cache(4096)
def size_class_bounds(num: int, den: int, most: int) -> np.ndarray:
    """First sizes of the size classes: a linked set lies in the class of the larger one or the one before."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return np.array(out, np.int64)


def class_parts(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """(parts, spare): of sets whose larger has low..high members, all linked pairs agree on more than `spare`
    parts. A set with no more than `spare` empty parts so agrees on one that is not empty."""
    union = 2 * high * den // (den + num)
    differ = (den - num) * union // den
    parts = differ + 1
    empty = parts * np.exp(-low * num / den / parts)
    spare = int(empty + 4 * empty**0.5) if parts > 1 else 0
    return parts + spare, spare


def set_signatures(members: np.ndarray, num: int, den: int, family: int = 0) -> np.ndarray:
    """Region keys of one set, given as sorted distinct uint64 hashes."""
    n = len(members)
    bounds = size_class_bounds(num, den, n)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    bounds = size_class_bounds(num, den, int(bounds[-1]) * den // num + 2)
    if family:
        members = np.sort(mix(members ^ np.uint64(family * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    weights = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members + np.uint64(1)), dtype=np.uint64)])
    out = []
    for c in (own, own + 1):
        low, high = int(bounds[c]), int(bounds[c + 1]) - 1
        if c > own and den * n < num * low:
            continue  # too small to link with any set of the next class
        parts, spare = class_parts(low, high, num, den)
        part = ((members >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cut = np.searchsorted(part, np.arange(parts + 1))
        size = np.diff(cut)
        value = weights[cut[1:]] - weights[cut[:-1]]
        key = mix(value ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64((c << 40) + (family << 56))))
        out.append(key if (size == 0).sum() > spare else key[size > 0])
    return np.concatenate(out)


class Sets:
    """Shingle sets of a block."""

    def __init__(self, payload: bytes, words: int):
        self.ids, lengths, buf = read_block(payload)
        hashes, n = block_words(lengths, buf)
        ends = np.cumsum(n)
        grams = hashes.copy()
        with np.errstate(over="ignore"):
            for k in range(1, words):
                grams[:-k] = mix(grams[:-k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:]) if len(grams) > k else grams[:-k]
        self.sets = []
        for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
            if b - a >= words:
                self.sets.append(np.unique(grams[a : b - words + 1]))
            elif b > a:  # the whole sequence is its one shingle
                self.sets.append(mix(np.array([int(np.bitwise_xor.reduce(mix(hashes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)))) ^ 0x5EED], np.uint64)))
            else:
                self.sets.append(np.zeros(0, np.uint64))


def _name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set beside its size."""
    with np.errstate(over="ignore"):
        sums = [np.sum(mix(s ^ np.uint64(salt)), dtype=np.uint64).reshape(1) for salt in (0, 0xA5A5A5A55A5A5A5A)]
    return tuple(int(mix(x).view(np.int64)[0]) for x in sums)


def shown(s: np.ndarray) -> np.ndarray:
    """The first members of equal shares of the hash space, where a share has any."""
    share = np.arange(MEETS, dtype=np.uint64) << np.uint64(64 - (MEETS - 1).bit_length())
    at = np.searchsorted(s, share)
    at = np.unique(at[at < len(s)])  # an empty share's first member is a later share's too
    return s[at]


def _describe(words: int):
    def run(block: int, payload: bytes) -> Iterator[pd.DataFrame]:
        s = Sets(payload, words)
        names = [_name(x) for x in s.sets]
        show = pd.Series([shown(x).view(np.int64) for x in s.sets], dtype=object)
        yield pd.DataFrame({"uid": block * BLOCK_DOCS + np.arange(len(s.ids)), "doc_id": s.ids, "n": [len(x) for x in s.sets], "h1": [n[0] for n in names], "h2": [n[1] for n in names], "show": show})

    return run


def _marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of a block as a bitmap."""
    for f in frames:
        bits = []
        for places in f["places"]:
            x = np.zeros(int(max(places)) + 1, bool)
            x[places] = True
            bits.append(np.packbits(x).tobytes())
        yield pd.DataFrame({"block": f["block"], "take": bits})


def taken(marks: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(marks, "u1")))


def _send(words: int, num: int, den: int, parts: int):
    """Keys of the parts of a block's distinct sets, with their places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, payload, take in zip(f["block"], f["payload"], f["take"], strict=True):
                s, keys, place = Sets(payload, words).sets, [], []
                for i in taken(take).tolist():
                    k = set_signatures(s[i], num, den)
                    keys.append(k)
                    place.append(np.full(len(k), i, "<u4"))
                keys = np.concatenate([np.zeros(0, np.uint64), *keys])
                place = np.concatenate([np.zeros(0, "<u4"), *place]).astype("<u4")
                order = np.argsort(keys)
                keys, place = keys[order], place[order]
                cuts = parts_of(keys, parts)
                rows = []
                for p in range(parts):
                    if cuts[p + 1] > cuts[p]:
                        c = slice(cuts[p], cuts[p + 1])
                        rows.append((block, p, join_values(squeeze_keys(keys[c]), squeeze_array(place[c]))))
                yield pd.DataFrame(rows, columns=["block", "part", "payload"])

    return run


def _regions(x: pd.DataFrame) -> pd.DataFrame:
    """(region, id) of keys that more than one set has. A region is named by its members, so that those of the same
    members are one."""
    sent = [split_values(p) for p in x["payload"]]
    keys = np.concatenate([unsqueeze_keys(s[0]) for s in sent])
    ids = np.concatenate([unsqueeze_array(s[1], "<u4").astype(np.int64) + b * BLOCK_DOCS for s, b in zip(sent, x["block"], strict=True)])
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(begin, append=len(keys))
    with np.errstate(over="ignore"):
        name = np.add.reduceat(mix(ids.view(np.uint64)), begin, dtype=np.uint64) if len(keys) else np.zeros(0, np.uint64)
        name = mix(name + size.astype(np.uint64)) >> np.uint64(2)
    first = np.zeros(len(begin), bool)
    first[np.unique(name, return_index=True)[1]] = True
    keep = np.repeat((size > 1) & first, size)
    return pd.DataFrame({"region": np.repeat(name, size)[keep].view(np.int64), "id": ids[keep]})


def sketch(s: np.ndarray) -> bytes:
    """How many members fall into each of CELLS cells; counts of 255 stand for more as well."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS), 255).astype("u1").tobytes()


@F.pandas_udf(T.LongType())
def _bound(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    """Members that two sets share at most: the smaller counts of the cells."""
    x, y = (np.frombuffer(b"".join(v), "u1").reshape(-1, CELLS) for v in (a, b))
    full = (x == 255).any(1) | (y == 255).any(1)
    return pd.Series(np.where(full, np.minimum(na, nb), np.minimum(x, y).sum(1, dtype=np.int64)))


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Members that two sets share."""
    return pd.Series([overlap(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(a, b, strict=True)], dtype="int64")


def _only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """sets of these ids (a written table), so that no others are shuffled."""
    few = ids.count() <= MOST_BROADCAST
    return sets.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _compare(pairs: DataFrame, sets: DataFrame, num: int, den: int, reach: int = 1) -> DataFrame:
    """Saved (a, b, link, near) of those pairs of sets that may be within reach radii by what their cells' counts allow."""
    both = lambda x, d, *cols: x.join(d.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols]), "a").join(d.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols]), "b")
    links = lambda common, r=1: F.col(common) * den >= F.lit(den - r * (den - num)) * (F.col("n_a") + F.col("n_b") - F.col(common))
    pairs = both(pairs, sets, "n", "sketch").withColumn("most", _bound("sketch_a", "sketch_b", "n_a", "n_b"))
    close = save(pairs.where(links("most", reach)).select("a", "b", "n_a", "n_b"), "close")
    ids = save(close.select(F.col("a").alias("id")).union(close.select("b")).distinct(), "ids")
    out = both(close, _only(sets, ids), "members").withColumn("common", _common("members_a", "members_b"))
    near = 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    out = save(out.select("a", "b", links("common").alias("link"), near.alias("near")), "distances")
    discard(close, ids)
    return out


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Members that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def join_region(names: list[int], sets: list[np.ndarray], roots: list[int], near: list[float], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join all linked sets of a region which are not of one class yet.

    near: distances to a first pivot, NaN where not measured. Each pivot is measured against what its window leaves, and then done.
    """
    root = np.unique(roots, return_inverse=True)[1]
    size, near_ = np.array([len(s) for s in sets]), np.array(near, float)
    open_, out = np.ones(len(sets), bool), []
    while (open_ & (root != root[int(np.argmax(open_))])).any():
        main = int(np.argmax(np.bincount(root[open_])))  # the largest class needs no pivots of its own
        p = int(np.flatnonzero(open_ & (root != main))[0])
        open_[p] = False
        window = open_ & (root != root[p]) & ~(np.abs(near_ - near_[p]) > 1 - num / den + SLACK)  # all where one is not known
        window &= np.minimum(size, size[p]) * den >= np.maximum(size, size[p]) * num
        for i in np.flatnonzero(window).tolist():
            if root[i] != root[p]:
                common = overlap(sets[i], sets[p])
                if den * common >= num * (size[i] + size[p] - common):
                    out.append((names[i], names[p]))
                    root[root == root[i]] = root[p]
    return out


def _close_pairs(num: int, den: int):
    """Pairs of small regions, given in order of region, whose sets are of different classes, inside each other's
    window and by their cells' counts may link; those with the pivot have been measured."""

    def pairs(region: pd.DataFrame, out: list[tuple[int, int]]) -> None:
        x = np.frombuffer(b"".join(region["sketch"]), "u1").reshape(-1, CELLS)
        ids, n, root, near = (region[c].to_numpy() for c in ("id", "n", "root", "near"))
        done = ids == region["pivot"].to_numpy()
        full = (x == 255).any(1)
        for i in range(len(ids) - 1):
            other = np.arange(i + 1, len(ids))
            other = other[(root[other] != root[i]) & ~done[other] & (np.minimum(n[other], n[i]) * den >= np.maximum(n[other], n[i]) * num) & ~(np.abs(near[other] - near[i]) > 1 - num / den + SLACK)]
            if done[i] or not len(other):
                continue
            most = np.where(full[other] | full[i], np.minimum(n[other], n[i]), np.minimum(x[other], x[i]).sum(1, dtype=np.int64))
            out += [(int(ids[j]), int(ids[i])) for j in other[den * most >= num * (n[other] + n[i] - most)]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            r, out = f["region"].to_numpy(), []
            cuts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])).tolist()
            for a, b in zip(cuts, cuts[1:]):
                pairs(f.iloc[a:b], out)
            rest = f.iloc[cuts[-1] :] if cuts else None  # may go on in the next batch
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if rest is not None:
            out = []
            pairs(rest, out)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def may_link(x: pd.DataFrame, num: int, den: int) -> np.ndarray:
    """Which rows of two pieces of a region have another one beside them, of another class and inside its window, that
    by the cells' counts they may link with. Those with the pivot have been measured, those of one of two pieces are
    met where it is alone."""
    order = np.argsort(x["n"].to_numpy(), kind="stable")
    n, root, near, piece, ids, pivot = (x[c].to_numpy()[order] for c in ("n", "root", "near", "piece", "id", "pivot"))
    cells = np.frombuffer(b"".join(x["sketch"]), "u1").reshape(-1, CELLS)[order]
    alone, done, full = bool((x["i"] == x["j"]).all()), ids == pivot, (cells == 255).any(1)
    ends = np.searchsorted(n, n * den // num, side="right")  # the largest sets that are not too large
    out = np.zeros(len(n), bool)
    for k in np.flatnonzero(~done).tolist():
        other = np.arange(k + 1, ends[k])
        take = (root[other] != root[k]) & ~done[other] & ~(np.abs(near[other] - near[k]) > 1 - num / den + SLACK)
        if not alone:
            take &= piece[other] != piece[k]
        if out[k]:
            take &= ~out[other]
        other = other[take]
        if len(other):
            most = np.where(full[other] | full[k], n[k], np.minimum(cells[other], cells[k]).sum(1, dtype=np.int64))
            other = other[den * most >= num * (n[other] + n[k] - most)]
            out[other] = True
            out[k] |= len(other) > 0
    back = np.empty(len(n), bool)
    back[order] = out
    return back


def _left_open(num: int, den: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        return x.loc[may_link(x, num, den), ["region", "i", "j", "id", "root", "near"]]

    return run


def _join_regions(num: int, den: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(m, "<u8") for m in x["members"]]
        links = join_region(x["id"].tolist(), sets, x["root"].tolist(), x["near"].tolist(), num, den)
        free_memory()
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _split_again(num: int, den: int, family: int):
    """Keys of the regions that each region of a set is split into; a set has none of them twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, ids, rows = [], [], 0
            for name, members, regions in zip(f["id"], f["members"], f["regions"], strict=True):
                own = np.unique(set_signatures(np.frombuffer(members, "<u8"), num, den, family))
                for r in regions:
                    keys.append(mix(own ^ np.uint64(int(r) & (1 << 64) - 1)).view(np.int64))
                    ids.append(np.full(len(own), name, np.int64))
                    rows += len(own)
                    if rows >= SPLIT_ROWS:
                        yield pd.DataFrame({"region": np.concatenate(keys), "id": np.concatenate(ids)})
                        keys, ids, rows = [], [], 0
            if rows:
                yield pd.DataFrame({"region": np.concatenate(keys), "id": np.concatenate(ids)})

    return run


def _pieces(x: DataFrame) -> DataFrame:
    """Rows of regions dealt to tasks of two pieces (i <= j); small regions are one piece."""
    size = x.groupBy("region").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("pieces"))
    x = x.join(size, "region").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return x.withColumn("i", F.least("piece", "other")).withColumn("j", F.greatest("piece", "other"))


def _join_open(x: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """links with those between sets of one region of x (region, id, n, pivot, near) that are not of one class by them."""
    for level in range(1, MOST_LEVELS + 1):
        roots = components(links)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # the next level starts from these stars
        x = x.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ = x.groupBy("region").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
        x = save(x.join(open_.select("region", "count", "shingles"), "region"), "open")
        if x.isEmpty():
            return links
        last = level == MOST_LEVELS
        small = x.where(F.col("count") <= LEAF).join(sets.select("id", "sketch"), "id").select("region", "id", "n", "root", "pivot", "near", "sketch")
        small = small.repartition("region").sortWithinPartitions("region")
        pairs = save(small.mapInPandas(tidy(_close_pairs(num, den)), "a long, b long").distinct(), "pairs")
        links = links.union(_compare(pairs, sets, num, den).where("link").select("a", "b"))
        # Regions with the same sets are one.
        fits = (F.col("count") <= GROUP * MOST_PIECES) & (F.col("shingles") <= GROUP_SHINGLES * MOST_PIECES)
        middle = x.where((F.col("count") > LEAF) & (F.lit(last) | fits))
        alike = middle.groupBy("region").agg(F.bit_xor(F.xxhash64("id")).alias("h"), F.sum(F.xxhash64("id", F.lit(1)) % (1 << 40)).alias("h2"), F.count("*").alias("k"))
        alike = alike.groupBy("h", "h2", "k").agg(F.min("region").alias("region")).select("region")
        middle = save(_pieces(middle.join(alike, "region")), "middle")
        if not middle.isEmpty():
            # Members go only to where a set may still link: nearly all of a region's pairs fall by their sketches.
            known = middle.join(sets.select("id", "sketch"), "id").select("region", "i", "j", "piece", "id", "n", "root", "pivot", "near", "sketch")
            left = save(known.groupBy("region", "i", "j").applyInPandas(_left_open(num, den), "region long, i int, j int, id long, root long, near double"), "left")
            ids = save(left.select("id").distinct(), "ids")
            joined = left.join(_only(sets, ids).select("id", "members"), "id")
            joined = joined.select("region", "i", "j", "id", "root", "near", "members").groupBy("region", "i", "j").applyInPandas(_join_regions(num, den), "a long, b long")
            links = links.union(save(joined, "links"))
            discard(left, ids)
        large = x.where((F.col("count") > LEAF) & ~fits)
        if last or large.isEmpty():
            return links
        mine = large.groupBy("id").agg(F.collect_set("region").alias("regions"))  # as many as a set has parts
        # Written, as it is read twice and costs Python time.
        split = save(sets.join(mine, "id").mapInPandas(tidy(_split_again(num, den, level)), "region long, id long"), "split")
        several = split.groupBy("region").agg(F.count("*").alias("size")).where("size > 1").select("region")
        # No pivot has been measured in the new regions: near is alike for all, which leaves windows by size alone.
        x = save(split.join(several, "region").join(sets.select("id", "n"), "id").select("region", "id", "n", F.lit(-1).cast("long").alias("pivot"), F.lit(0.0).alias("near")), "regions")
        discard(split)
    return links


def _met(one: DataFrame) -> DataFrame:
    """(id, pivot) of sets and the pivots that they share two shown shingles with, or one if they show few."""
    show = one.select("id", "h1", F.size("show").alias("k"), F.explode("show").alias("key"))
    pivots = show.groupBy("key").agg(F.count("*").alias("many"), F.min_by("id", F.struct("h1", "id")).alias("pivot")).where("many > 1").select("key", "pivot")
    met = show.join(pivots, "key").where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("times"), F.first("k").alias("k"))
    return met.where((F.col("times") >= 2) | (F.col("k") <= MEETS // 2)).select(F.col("id").alias("a"), F.col("pivot").alias("b"))


def jaccard_join(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text).

    Sets link when den * common >= num * union. component_id is the smallest doc_id that links reach, the
    row's own included. Texts without words, or null, have empty sets and link with nothing; texts with fewer
    words than a shingle have one shingle; rows with equal texts link. A null doc_id stands first and its
    component is null. Other columns are left out; an empty table gives an empty result. The log tells how many
    sets pivots' regions have joined to others, and how many the keys have added.
    """
    blocks = to_blocks(docs, block_bytes=BLOCK_BYTES)
    parts = parts_for(blocks)
    rows = save(map_blocks(blocks, _describe(words), "uid long, doc_id long, n long, h1 long, h2 long, show array<long>"), "sets")
    n_rows = rows.count()
    # Equal sets are one, called by its first row.
    name = ["n", "h1", "h2"]
    one = save(rows.where("n > 0").groupBy(*name).agg(F.min("uid").alias("id"), F.min("doc_id").alias("least"), F.any_value("show").alias("show")), "distinct")

    def in_blocks(ids: DataFrame) -> DataFrame:
        """blocks with a bitmap of some sets' places; blocks themselves move only where bitmaps are large."""
        at = ids.select(F.shiftright("id", 20).alias("block"), (F.col("id") % BLOCK_DOCS).cast("int").alias("place"))
        marks = save(at.groupBy("block").agg(F.collect_list("place").alias("places")).mapInPandas(_marks, "block long, take binary"), "marks")
        return blocks.join(F.broadcast(marks) if n_rows <= MOST_MARKED else marks, "block")

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, payload, take in zip(f["block"], f["payload"], f["take"], strict=True):
                s, at = Sets(payload, words).sets, taken(take).tolist()
                yield pd.DataFrame({"id": [block * BLOCK_DOCS + i for i in at], "n": [len(s[i]) for i in at], "members": [s[i].astype("<u8").tobytes() for i in at], "sketch": [sketch(s[i]) for i in at]})

    def members(ids: DataFrame) -> DataFrame:
        return save(in_blocks(ids).mapInPandas(tidy(pick), "id long, n long, members binary, sketch binary"), "members", "none")

    # Voronoi regions of the pivots, and their boundary sets.
    met = save(_met(one), "met")
    sets = members(met.select(F.col("a").alias("id")).union(met.select("b")).distinct())
    done = _compare(met, sets, num, den, REACH)
    links = done.where("link").select("a", "b")
    window = F.least(F.lit(REACH * (1 - num / den)), F.col("least") + 2 * (1 - num / den)) + SLACK
    least = done.groupBy("a").agg(F.min("near").alias("least"))
    cells = done.join(least, "a").where(F.col("near") <= window).select(F.col("b").alias("region"), F.col("a").alias("id"), F.col("b").alias("pivot"), "near")
    own = cells.select("region", F.col("region").alias("id"), F.col("region").alias("pivot"), F.lit(0.0).alias("near")).distinct()
    cells = save(cells.unionByName(own).join(one.select("id", "n"), "id").select("region", "id", "n", "pivot", "near"), "cells")
    links = save(_join_open(cells, links, sets, num, den), "links")
    roots = components(links).withColumnRenamed("node", "id")
    by_pivots = roots.where("id <> root").count()
    discard(met, done, cells, sets)
    free_heaps(docs.sparkSession)

    # The rest: regions of equal parts with sets of several classes. A region's pivot shares most regions, as the
    # origin of a family of copies does.
    sent = in_blocks(one).mapInPandas(tidy(_send(words, num, den, parts)), PART_SCHEMA)
    found = save(at_parts(sent, _regions, "region long, id long").distinct(), "found")
    flat = found.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = flat.groupBy("region").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 <> r1").select("region", "size")
    flat = save(found.join(several, "region"), "several")
    sets = members(flat.select("id").distinct())
    weight = flat.groupBy("id").agg(F.count("*").alias("weight"))
    pivot = flat.join(weight, "id").groupBy("region").agg(F.max(F.struct("weight", "id")).getField("id").alias("pivot"))
    regions = save(flat.join(pivot, "region"), "regions")
    done = _compare(regions.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), sets, num, den)
    # A region of two is done where one is its pivot.
    at = done.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "near")
    x = regions.where("size > 2").join(at, ["id", "pivot"], "left").join(one.select("id", "n"), "id")
    x = x.select("region", "id", "n", "pivot", F.when(F.col("id") == F.col("pivot"), 0.0).otherwise(F.col("near")).alias("near"))
    links = links.union(done.where("link").select("a", "b"))
    links = save(_join_open(x, links, sets, num, den), "links")

    roots = components(links).withColumnRenamed("node", "id")
    log.info("sets joined to others: %d in regions of pivots, %d more by keys of parts", by_pivots, roots.where("id <> root").count() - by_pivots)
    classes = one.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = classes.groupBy("root").agg(F.min("least").alias("component"))
    classes = classes.join(least, "root").select(*name, "component")
    out = rows.where("n > 0").join(classes, name).select("doc_id", "n", "component").unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    out = save(out.select(known("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id")), "classes")
    discard(blocks, rows, one, found, flat, regions, done, sets)
    return out


def keep_first_of_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, with the row of the smallest doc_id of each group of linked documents.

    Rows without words are no group and stay; rows that repeat the kept doc_id stay with it.
    """
    groups = jaccard_join(docs.select("doc_id", "text"), words, num, den)
    others = groups.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
