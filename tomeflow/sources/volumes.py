"""Texts stored as volumes: chapters by byte ranges, bounded parts, a checked manifest, and reads of ranges.

Offsets are of UTF-8 bytes, ends exclusive. A text's volumes are rows of a table, so a range is read by a join on the
volumes that it touches, and only the piece that is asked for is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import bound_batches

#: Blanks; signs of numbers; what follows a number; names that are headings alone; what may stand
#: between a heading and its caption, and what no caption holds; titles of what has no heading; most bytes of a
#: heading's line and most characters of its title.
BLANK = " \t\v\f\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NUMERALS = "0-9０-９〇零一二两三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億"
UNITS = "章回节卷部篇集"
NAMES = ("序章", "序言", "前言", "序", "楔子", "引子", "后记", "尾声", "终章")
BETWEEN = r" \t\u3000:：、.．\-—"
NO_CAPTION = "。；;"
PREFACE, BODY = "前言", "正文"
MOST_LINE_BYTES, MOST_TITLE_CHARS = 320, 80
#: Most bytes of a part, of a volume by choice, and of one whatever its chapters are; the manifest's kind.
PART_BYTES, VOLUME_BYTES, MOST_VOLUME_BYTES = 32 * 1024, 8 * 1024 * 1024, 16 * 1024 * 1024
SCHEMA, FORMAT = 2, "volumes"

_GAP = r"[ \t\u3000]"
_LABEL = re.compile(
    rf"(?:(?:{BODY}{_GAP}+)?第{_GAP}*[{NUMERALS}]{{1,20}}{_GAP}*[{UNITS}]|{'|'.join(NAMES)}|番外[{NUMERALS}]{{0,20}}|chapter{_GAP}+(?:[0-9０-９]{{1,9}}|[ivxlcdm]{{1,12}}))(?P<rest>[^\r\n]*)",
    re.IGNORECASE,
)
_MAY_BE = re.compile(rf"(?:\A|(?<=[\r\n]))[{BLANK}]*(?=[第正番【c{''.join(sorted({n[0] for n in NAMES}))}])[^\r\n]+", re.IGNORECASE)
_CAPTION = re.compile(rf"[{BETWEEN}]++(?P<caption>[^{NO_CAPTION}]*[^{NO_CAPTION}.])")
_EDGES = re.compile(rf"\A[{BLANK}]+|[{BLANK}]+\Z")
_CONTENT = re.compile(rf"[^{BLANK}\r\n]")

CHAPTER = "struct<no int, title string, first_byte bigint, last_byte bigint, volume int, parts int>"
VOLUME = "struct<no int, first_byte bigint, last_byte bigint>"
LAYOUT = f"struct<chapters array<{CHAPTER}>, volumes array<{VOLUME}>>"


def title_of(line: str) -> str | None:
    """The title that a line is, as a heading; None for a line of text."""
    title = _EDGES.sub("", line)
    if len(line.encode()) > MOST_LINE_BYTES or len(title) > MOST_TITLE_CHARS:
        return None
    wrapped = len(title) > 1 and title[0] + title[-1] == "【】"
    m = _LABEL.match(_EDGES.sub("", title[1:-1]) if wrapped else title)
    if m is None:
        return None
    return title if wrapped or not m["rest"] or _CAPTION.fullmatch(m["rest"]) else None


def chapter_starts(text: str) -> list[tuple[str, int]]:
    """(title, first byte) of a text's chapters, which cover it; none for a blank text.

    Blanks before the first heading are of its chapter; anything else there is a preface. A text without headings is
    one chapter. Lines end with LF, CRLF or CR.
    """
    content = _CONTENT.search(text)
    if content is None:
        return []
    out: list[tuple[str, int]] = []
    at = size = 0
    for m in _MAY_BE.finditer(text):
        title = title_of(m.group())
        if title is None:
            continue
        size += len(text[at : m.start()].encode())
        at = m.start()
        if not out and content.start() < at:
            out.append((PREFACE, 0))
        out.append((title, size if out else 0))
    return out or [(BODY, 0)]


def _boundary(data: bytes, at: int, least: int) -> int:
    """The last place up to `at`, and after `least`, that is in no character and no CRLF."""
    while at > least and data[at] & 0xC0 == 0x80:
        at -= 1
    if at - 1 > least and data[at - 1 : at + 1] == b"\r\n":
        at -= 1
    if at == least:
        raise ValueError("not UTF-8")
    return at


def part_ends(data: bytes, first: int, last: int, most: int = PART_BYTES) -> Iterator[int]:
    """Where parts of at most so many bytes end: behind the last line end in a part's latter half, else anywhere."""
    if most < 4:
        raise ValueError("a part has at least 4 bytes")
    while first < last:
        end = min(first + most, last)
        if end < last:
            end = _boundary(data, end, first)
            half = first + most // 2
            end = max(data.rfind(b"\n", half, end), data.rfind(b"\r", half, end)) + 1 or end
        yield end
        first = end


def volume_ends(data: bytes, chapter_ends: list[int], soft: int, hard: int) -> Iterator[int]:
    """Where volumes end: chapters in order as long as they fit, whole; only one above the hard limit is cut."""
    first = whole = 0
    for end in chapter_ends:
        if end - first > soft and whole > first:
            yield whole
            first = whole
        while end - first > hard:
            first = _boundary(data, first + hard, first)
            yield first
        whole = end
        if whole - first >= soft:
            yield whole
            first = whole
    if whole > first:
        yield whole


def _layout(text: str, soft: int, hard: int, part: int) -> dict:
    data = text.encode()
    starts = chapter_starts(text)
    ends = [s for _, s in starts[1:]] + [len(data)] if starts else []
    volumes, first = [], 0
    for no, end in enumerate(volume_ends(data, ends or [len(data)], soft, hard)):
        volumes.append({"no": no, "first_byte": first, "last_byte": end})
        first = end
    chapters, v = [], 0
    for no, ((title, s), e) in enumerate(zip(starts, ends, strict=True)):
        while volumes[v]["last_byte"] <= s:
            v += 1
        chapters.append({"no": no, "title": title, "first_byte": s, "last_byte": e, "volume": v, "parts": sum(1 for _ in part_ends(data, s, e, part))})
    return {"chapters": chapters, "volumes": volumes}


def layout(text: Column, soft: int = VOLUME_BYTES, hard: int = MOST_VOLUME_BYTES, part: int = PART_BYTES) -> Column:
    """struct(chapters, volumes) of a text; null for null, and no chapters for a blank one, whose bytes are stored
    nevertheless. A text is one row's, so its bytes are its task's."""

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [None if s is None else _layout(s, soft, hard, part) for s in texts]
        return pd.DataFrame({c: [None if x is None else x[c] for x in found] for c in ("chapters", "volumes")}, dtype="object")

    return F.when(text.isNotNull(), F.pandas_udf(run, LAYOUT)(text))


@F.pandas_udf(T.ArrayType(T.StructType().add("first_byte", T.LongType()).add("last_byte", T.LongType())))
def parts(data: pd.Series, most: pd.Series) -> pd.Series:
    """Ranges of a text's bytes, each within the limit of its row; none for null and for no bytes."""

    def one(b, n):
        ends = [] if b is None else list(part_ends(bytes(b), 0, len(b), int(n)))
        return [{"first_byte": a, "last_byte": e} for a, e in zip([0, *ends], ends, strict=False)]

    return pd.Series([one(b, n) for b, n in zip(data, most, strict=True)], dtype="object")


def blob_sha(data: Column) -> Column:
    """The name of bytes in a content store: SHA-1 of a head with their length, and the bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"), F.lit(bytearray(1)), data))


def _slice(data: Column, first: Column, last: Column) -> Column:
    return F.substring(data, (first + 1).cast("int"), (last - first).cast("int"))


MANIFEST = (
    "schema int, format string, version string, blob_sha string, bytes bigint, chars bigint, chapters int, "
    "volumes array<struct<blob_sha string, bytes bigint, first_byte bigint, last_byte bigint>>, "
    "chapter_index array<struct<i int, t string, v int, s bigint, e bigint, p int>>"
)


def write(books: DataFrame, key: str, text: str, path: str, soft: int = VOLUME_BYTES, hard: int = MOST_VOLUME_BYTES, part: int = PART_BYTES) -> None:
    """Tables `volumes` (key, volume, data) and `manifests` (key, manifest) of texts below a path.

    Keys are expected once; rows with a null key or a null or empty text are not stored. No shuffle: a text's volumes
    are cut where it lies, and its manifest is computed in a second pass over the input rather than held.
    """
    bound_batches(books.sparkSession)
    x = books.where(F.col(key).isNotNull() & (F.octet_length(text) > 0)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.encode(text, "UTF-8").alias("data"), layout(F.col(text), soft, hard, part).alias("l"))
    cut = lambda v: _slice(F.col("data"), v["first_byte"], v["last_byte"])
    one = x.select("key", "data", F.explode("l.volumes").alias("v"))
    one.select("key", F.col("v.no").alias("volume"), cut(F.col("v")).alias("data")).write.parquet(f"{path}/volumes")
    vols = F.transform("l.volumes", lambda v: F.struct(blob_sha(cut(v)).alias("blob_sha"), (v["last_byte"] - v["first_byte"]).alias("bytes"), v["first_byte"], v["last_byte"]))
    index = F.transform("l.chapters", lambda c: F.struct(c["no"].alias("i"), c["title"].alias("t"), c["volume"].alias("v"), c["first_byte"].alias("s"), c["last_byte"].alias("e"), c["parts"].alias("p")))
    sha = blob_sha(F.col("data"))
    m = F.struct(
        F.lit(SCHEMA).alias("schema"), F.lit(FORMAT).alias("format"), F.substring(sha, 1, 8).alias("version"), sha.alias("blob_sha"), F.octet_length("data").cast("bigint").alias("bytes"), F.char_length("text").cast("bigint").alias("chars"),
        F.size("l.chapters").alias("chapters"), vols.alias("volumes"), index.alias("chapter_index"),
    )
    x.select("key", F.to_json(m).alias("manifest")).write.parquet(f"{path}/manifests")


def valid_manifest(m: Column) -> Column:
    """Whether a parsed manifest holds: its version, names, volumes that follow each other from 0 to the end, and
    chapters in order, not over each other, each beginning in its volume. False for null."""
    v, c = m["volumes"], m["chapter_index"]
    following = F.forall(F.sequence(F.lit(1), F.size(v)), lambda i: F.get(v, i - 1)["first_byte"] == F.when(i == 1, F.lit(0)).otherwise(F.get(v, i - 2)["last_byte"]))
    volume = F.forall(v, lambda x: x["blob_sha"].rlike("^[0-9a-f]{40}$") & (x["bytes"] > 0) & (x["bytes"] <= MOST_VOLUME_BYTES) & (x["last_byte"] - x["first_byte"] == x["bytes"]))
    of = lambda x: F.get(v, x["v"])
    fits = lambda x, i: (x["i"] == i) & x["t"].isNotNull() & (x["v"] >= 0) & (x["s"] >= 0) & (x["s"] < x["e"]) & (x["e"] <= m["bytes"]) & (x["p"] >= 1) & (x["s"] >= of(x)["first_byte"]) & (x["s"] < of(x)["last_byte"])
    entry = F.forall(F.transform(c, lambda x, i: fits(x, i) & ((i == 0) | (x["s"] >= F.get(c, i - 1)["e"]))), lambda ok: F.coalesce(ok, F.lit(False)))
    head = (m["schema"] == SCHEMA) & (m["format"] == FORMAT) & m["blob_sha"].rlike("^[0-9a-f]{40}$") & (F.substring(m["blob_sha"], 1, 8) == m["version"]) & (m["bytes"] > 0) & (m["chars"] >= 0) & (m["chapters"] == F.size(c))
    whole = F.when(F.size(v) >= 1, following & volume & (F.element_at(v, -1)["last_byte"] == m["bytes"]))
    return F.coalesce(head & whole & entry, F.lit(False))


def manifests(rows: DataFrame, column: str = "manifest") -> DataFrame:
    """rows with the parsed manifest in place of its text; null if it is no manifest or doesn't hold."""
    x = rows.withColumn(column, F.from_json(column, MANIFEST))
    return x.withColumn(column, F.when(valid_manifest(F.col(column)), F.col(column)))


def read_ranges(wanted: DataFrame, stored: DataFrame, volumes: DataFrame) -> DataFrame:
    """(key, first_byte, last_byte, data, error) of each distinct wanted range.

    stored are the manifests as read by `manifests`. Instead of data there is an error for a text without a manifest
    that holds, a range that isn't within it, and a volume that is missing or whose bytes aren't those of its name.
    """
    w = wanted.select("key", "first_byte", "last_byte").distinct().join(stored.select("key", F.col("manifest").alias("m")), "key", "left")
    inside = (F.col("first_byte") >= 0) & (F.col("first_byte") < F.col("last_byte")) & (F.col("last_byte") <= F.col("m.bytes"))
    error = F.when(F.col("m").isNull(), "no manifest").when(~F.coalesce(inside, F.lit(False)), "no such range")
    met = F.filter(F.transform("m.volumes", lambda v, i: F.struct(i.alias("no"), v.alias("v"))), lambda x: (x["v"]["first_byte"] < F.col("last_byte")) & (x["v"]["last_byte"] > F.col("first_byte")))
    w = w.select("key", "first_byte", "last_byte", error.alias("error"), F.explode_outer(F.when(error.isNull(), met)).alias("x"))
    w = w.select("key", "first_byte", "last_byte", "error", F.col("x.no").alias("volume"), F.col("x.v").alias("v"))
    j = w.join(volumes, ["key", "volume"], "left")
    good = blob_sha(F.col("data")) == F.col("v.blob_sha")
    at = lambda c: F.greatest(F.least(F.col(c), F.col("v.last_byte")), F.col("v.first_byte")) - F.col("v.first_byte")
    piece = F.when(good, _slice(F.col("data"), at("first_byte"), at("last_byte")))
    failed = F.coalesce("error", F.when(F.col("data").isNull(), "no volume").when(~good, "wrong bytes"))
    # Pieces of one range: the volumes that it touches.
    out = j.groupBy("key", "first_byte", "last_byte").agg(F.array_sort(F.collect_list(F.struct("volume", piece.alias("piece")))).alias("p"), F.min(failed).alias("error"))
    data = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    return out.select("key", "first_byte", "last_byte", F.when(F.col("error").isNull(), data).alias("data"), "error")


def bounded_files(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(path, length, text, error) of files: those above the limit or not UTF-8 have an error and no text.

    Files above the limit are told by their length and not read. Empty files have no row: Spark's file scan plans none.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most).select("path", "length", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    small = small.withColumn("error", F.when(F.col("text").isNull(), "invalid-utf8"))
    large = files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("string").alias("text"), F.lit("too-large").alias("error"))
    return small.unionByName(large)
