"""Line rules, previews, fingerprints and containment for texts, as built-in column expressions."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import saved

#: Patterns of lines that carry no content, the first that fits gives the reason.
LINE_RULES = (
    ("rights", r"(?i)all rights reserved|licensed under|released under"),
    ("link", r"(?i)^\s*https?://\S+\s*$"),
    ("nav", r"(\S+ \| ){2,}"),
    ("marker", r"^\s*[#*=_-]{3,}\s*$"),
)


def line_reason(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LINE_RULES):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def dropped_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, reason) of the lines that a rule drops."""
    return lines(docs, key, text).withColumn("reason", line_reason(F.col("line"))).where("reason is not null").select(key, "line_no", "reason")


def dedupe_long_lines(docs: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    """(key, line_no, line): the first of equal long lines of a text, and all short ones."""
    x = lines(docs, key, text)
    w = Window.partitionBy(key, F.xxhash64("line"), "line").orderBy("line_no")
    return x.withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) | (F.char_length("line") < least)).drop("rn")


def template_lines(docs: DataFrame, key: str, text: str, least_docs: int = 2, least_chars: int = 2) -> DataFrame:
    """(line_hash, docs) of lines that stand in several texts; only hashes are shuffled."""
    x = lines(docs, key, text).where(F.char_length(F.btrim("line")) >= least_chars)
    x = x.select(key, F.md5(F.btrim("line")).alias("line_hash")).distinct()
    return x.groupBy("line_hash").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)


def is_preview(text: Column, most: int = 200) -> Column:
    return (F.char_length(text) <= most) & F.btrim(text).rlike("(…|\\.\\.\\.)$")


def prepare_verdict(docs: DataFrame, key: str, text: str, least: int = 500) -> DataFrame:
    """(key, chars, kept_chars, verdict): the first failing rule of a text's preparation."""
    x = docs.withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    x = x.withColumn("__kept", F.filter("__lines", lambda s: line_reason(s).isNull()))
    n = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + F.char_length(s))
    x = x.withColumn("chars", n("__lines")).withColumn("kept_chars", n("__kept"))
    verdict = (
        F.when(F.col("chars") == 0, "empty").when(is_preview(F.col(text)), "preview").when(F.col("kept_chars") < 0.7 * F.col("chars"), "noisy").when(F.col("kept_chars") < least, "short").otherwise("ready")
    )
    return x.select(key, "chars", "kept_chars", verdict.alias("verdict"))


def wrong_decode_ratio(text: Column) -> Column:
    """Share of characters that look like bytes read in a wrong charset."""
    return F.coalesce(F.regexp_count(text, F.lit("[ÃÂâ€�]")) / F.nullif(F.char_length(text), F.lit(0)), F.lit(0.0))


#: Distinct windows up to which the smaller side of a containment join is broadcast.
MOST_BROADCAST = 1_000_000


def word_windows(rows: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, h): distinct hashes of every n words in a row of each text, lower case.

    Words are a column of their own, so that a text is split once and not for each window.
    """
    words = F.col("__words")
    x = rows.select(key, F.filter(F.split(F.lower(text), "[ \\t\\r\\n]+"), lambda w: w != "").alias("__words"))
    windows = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, F.lit(n)), " "))))
    return x.select(key, F.explode(F.array_distinct(windows)).alias("h"))


def contained_items(docs: DataFrame, doc_key: str, items: DataFrame, item_key: str, text: str = "text", n: int = 8) -> DataFrame:
    """(doc_key, item_key, hits): items of which a text holds word windows, with the number of distinct ones.

    Both sides are windows joined by hash. The items' windows are broadcast if they are few, so that those of the
    texts are never shuffled; else both sides are, each window once a text.
    """
    d, i = word_windows(docs, doc_key, text, n), word_windows(items, item_key, text, n)
    if i.count() <= MOST_BROADCAST:
        i = F.broadcast(i)
    return d.join(i, "h").groupBy(doc_key, item_key).agg(F.count("*").alias("hits"))


#: Titles of a size class that are compared at once with as many; and pairs of titles that numpy takes at a time.
PIECE, ROWS, COLUMNS = 16_384, 64, 4_096
MOST_TASKS = 2_000
#: Distinct grams of a meeting up to which a title is a row of bits.
MOST_GRAMS = 4_096
#: Bits of a title's sketch, and how many of them are compared first.
SKETCH_BITS, FIRST_BITS = 512, 128


def gram_set(k: str, n: int, step: int = 1) -> set:
    """Distinct runs of n characters, or of those at every so many; a shorter text is one itself."""
    return {k[i : i + n] for i in range(0, max(1, len(k) - n + 1), step)}


def title_sketch(k: Column, n: int) -> Column:
    """(n, grams, s): the number of a title's grams, these in a row, and a bit for each of SKETCH_BITS shares of all
    grams, set if an odd number of the title's are there; so two titles differ in as many grams as bits at least."""

    def run(titles: pd.Series) -> pd.DataFrame:
        sizes, rows, bits = [], [], []
        for t in titles:
            odd, grams = 0, sorted(gram_set(t, n))
            for g in grams:
                odd ^= 1 << (zlib.crc32(g.encode("utf-8", "surrogatepass")) % SKETCH_BITS)
            sizes.append(len(grams))
            rows.append("".join(grams))
            bits.append(odd.to_bytes(SKETCH_BITS // 8, "little"))
        return pd.DataFrame({"n": pd.Series(sizes, dtype="int32"), "grams": pd.Series(rows, dtype="object"), "s": pd.Series(bits, dtype="object")})

    return F.pandas_udf(run, "n int, grams string, s binary")(k)


def near_sketches(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows whose sets may have this Jaccard similarity, by their sizes and sketches; sizes ascend."""
    share = (1 - least) / (1 + least)  # of both sizes, that may differ
    for i in range(0, len(na), ROWS):
        for j in range(0, len(nb), COLUMNS):
            x, y, nx, ny = a[i : i + ROWS], b[j : j + COLUMNS], na[i : i + ROWS], nb[j : j + COLUMNS]
            if nx[-1] < least * ny[0] or ny[-1] < least * nx[0] or a is b and j + COLUMNS <= i:
                continue
            # Some of the bits first: most pairs differ in too many of them.
            first = FIRST_BITS // 64
            differ = functools.reduce(np.add, (np.bitwise_count(x[:, w, None] ^ y[None, :, w]) for w in range(first)))
            p, q = np.divmod(np.flatnonzero(differ <= min(share * (int(nx[-1]) + int(ny[-1])), 255)), len(y))
            rest = sum(np.bitwise_count(x[p, w] ^ y[q, w]).astype("int32") for w in range(first, SKETCH_BITS // 64))
            fits = (differ[p, q] + rest <= share * (nx[p] + ny[q])) & (nx[p] >= least * ny[q]) & (ny[q] >= least * nx[p])
            yield p[fits] + i, q[fits] + j


def common_grams(x: list[str], y: list[str], n: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For places in two lists of titles, each its distinct grams in a row: how many grams both have."""
    places: dict[str, int] = {}
    of = lambda g: [places.setdefault(g[i : i + n], len(places)) for i in range(0, max(1, len(g) - n + 1), n)]
    sides = [[of(g) for g in titles] if len(places) <= MOST_GRAMS else None for titles in (x, y)]
    if len(places) > MOST_GRAMS:
        return lambda p, q: np.array([len(gram_set(x[i], n, n) & gram_set(y[j], n, n)) for i, j in zip(p.tolist(), q.tolist(), strict=True)], dtype="int32")
    bits = []
    for side in sides:
        b = np.zeros((len(side), -(-len(places) // 64) * 64), dtype="bool")
        for i, at in enumerate(side):
            b[i, at] = True
        bits.append(np.packbits(b, axis=1).view("u8"))
    return lambda p, q: np.bitwise_count(bits[0][p] & bits[1][q]).sum(axis=1, dtype="int32")


def similar_titles(rows: DataFrame, key: str, title: str, block: str, least: float = 0.7, n: int = 2) -> DataFrame:
    """(a, b, score): titles of a block whose n-gram sets have this Jaccard similarity.

    Equal loose titles are one before the join, so a common title costs one row; one of less than n characters is a
    single gram. Titles are dealt by block and size class to pieces that meet two by two in a task of their own; pairs
    whose sketches may be alike are compared in full there, so that only alike pairs leave it.
    """
    k = rows.select(key, block, X.loose_key(F.col(title)).alias("k")).where("k <> ''").groupBy(F.col(block).alias("block"), "k").agg(F.min(key).alias("id"))
    x = k.where("block is not null and id is not null").withColumn("t", title_sketch(F.col("k"), n)).select("block", "id", F.xxhash64("k").alias("h"), "t.*")
    x = saved(x, "titles")
    low = least - 1e-6  # scores are rounded
    # Alike titles are of one class or of neighbours.
    c = x.withColumn("c", F.floor(F.log("n") / -math.log(low - 0.01)).cast("int"))
    pieces = c.groupBy("block", "c").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("own"))
    side = lambda by, name: pieces.select("block", (F.col("c") + by).alias("c"), F.col("own").alias(name))
    c = c.join(pieces, ["block", "c"]).join(side(-1, "above"), ["block", "c"], "left").join(side(1, "below"), ["block", "c"], "left").withColumn("p", F.pmod("h", "own").cast("int"))
    meets = lambda of, at: F.when(F.col(of) > 0, F.transform(F.sequence(F.lit(0), F.col(of) - 1), at)).otherwise(F.array())
    met = lambda c, i, up, j, right: F.struct(c.alias("low"), i.alias("i"), F.lit(up).alias("up"), j.alias("j"), right.alias("right"))
    own = meets("own", lambda q: met(F.col("c"), F.least("p", q), 0, F.greatest("p", q), F.col("p") > q))
    above = meets("above", lambda q: met(F.col("c"), F.col("p"), 1, q, F.lit(False)))
    below = meets("below", lambda q: met(F.col("c") - 1, q, 1, F.col("p"), F.lit(True)))
    each = c.select("block", "id", "n", "grams", "s", F.explode(F.concat(own, above, below)).alias("m")).select("block", "m.*", "id", "n", "grams", "s")
    kind = x.schema["id"].dataType.simpleString()

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).sort_values("n", ignore_index=True)
        alone = f["up"].iloc[0] == 0 and f["i"].iloc[0] == f["j"].iloc[0]
        words = lambda g: np.frombuffer(b"".join(g["s"]), dtype="<u8").reshape(-1, SKETCH_BITS // 64)
        x, y = (f, f) if alone else (f[~f["right"]].reset_index(drop=True), f[f["right"]].reset_index(drop=True))
        if x.empty or y.empty:
            return
        common, sx = common_grams(x["grams"].tolist(), y["grams"].tolist(), n), words(x)
        for i, j in near_sketches(x["n"].to_numpy(), sx, y["n"].to_numpy(), sx if alone else words(y), low):
            if alone:
                i, j = i[i < j], j[i < j]
            out = pd.DataFrame({"a": x["id"].to_numpy()[i], "b": y["id"].to_numpy()[j], "common": common(i, j), "both": x["n"].to_numpy()[i] + y["n"].to_numpy()[j]})
            yield out[out["common"] >= low * (out["both"] - out["common"])]

    by = ["block", "low", "i", "up", "j"]
    # Few bytes that take long: as many tasks as there are meetings, up to a limit.
    tasks = each.select(*by).distinct().count()
    near = each.repartition(max(1, min(tasks, MOST_TASKS)), *by).groupBy(*by).applyInPandas(compare, f"a {kind}, b {kind}, common int, both int")
    score = F.round(F.col("common") / (F.col("both") - F.col("common")), 6)
    return near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), score.alias("score")).where(F.col("score") >= least)
