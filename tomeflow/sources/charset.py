"""Bytes to text: which charset a page declares, decoding that prefers strict UTF-8, bodies that are HTML or JSON, and
mending of text that was read in the wrong charset.

Looking for a declaration, UTF-8 and the sniffing of bodies are built-in expressions; only rows in a Chinese charset
go through Python, whose codecs know it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Names of charsets, and the one that each is read as; bytes of a page in which a declaration counts.
NAMES = {"utf-8": "utf-8", "utf8": "utf-8", "gbk": "gbk", "gb2312": "gbk", "gb-2312": "gbk", "x-gbk": "gbk", "gb18030": "gb18030"}
HEAD_BYTES = 1024

#: The prefix of a body that is Base64, and the most bytes that are decoded.
BASE64_PREFIX = "inte_base64:"
MOST_DECODED = 8 * 1024 * 1024

#: Frequent characters and punctuation; share of misread characters from which a line is suspect, and
#: below which a mended text is good.
FREQUENT = (
    "的一是了我不人在他有这个上们来到时大地为子中你说生国年着就那和要她出也"
    "得里后自以会家可下而过天去能对小多然于心学么之都好看起发当没成只如事把还用"
    "第样道想作种开美总从无情己面最女但现前些所同日手又行意动方期它头经长儿回位分爱"
    "，。！？、；：“”（）《》"
)
SUSPECT, MENDED = 0.15, 0.05


def _misread() -> str:
    """Chinese characters that appear when the frequent ones' UTF-8 bytes are read as GBK."""
    return "".join(sorted({c for c in FREQUENT.encode().decode("gbk", "ignore") if "一" <= c <= "鿿"}))


def known_charset(name: Column) -> Column:
    """The charset that a name stands for, whatever its case and blanks around it; null for unknown ones."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.element_at(names, F.lower(F.btrim(name)))


def header_charset(content_type: Column) -> Column:
    """Of a content type; null without a known one."""
    return known_charset(F.regexp_extract(content_type, r'(?i)charset\s*=\s*"?([\w-]+)', 1))


def page_charset(body: Column) -> Column:
    """Of the first meta tag in the head, within the page's first bytes, that declares a known one; else null.

    Tags that the limit cuts, and tags within comments or scripts or behind the head, don't count.
    """
    prefix = F.decode(F.substring(body, 1, HEAD_BYTES), "ISO-8859-1")
    head = F.regexp_extract(prefix, r"(?is)<html\b[^>]*>\s*(?:<!--.*?-->\s*)*<head\b[^>]*>(.*)$", 1)
    head = F.regexp_replace(head, r"(?is)<!--.*?(?:-->|$)|<(script|style|title|noscript)\b.*?(?:</\1\s*>|$)", "")
    head = F.regexp_replace(head, r"(?is)</head\b.*$|<body\b.*$", "")
    tags = F.regexp_extract_all(head, F.lit(r"(?i)<meta\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"), F.lit(1))
    own = lambda t: known_charset(F.regexp_extract(t, r"(?i)(?:^|[\s\"'/])charset\s*=\s*[\"']?\s*([\w-]+)", 1))
    typed = lambda t: t.rlike(r"(?i)http-equiv\s*=\s*[\"']?\s*content-type")
    content = lambda t: F.regexp_extract(t, r"(?i)\bcontent\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    plain = lambda t: F.regexp_replace(t, r"(?i)\bcontent\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    found = F.transform(tags, lambda t: F.coalesce(own(plain(t)), F.when(typed(t), header_charset(content(t)))))
    return F.get(F.filter(found, lambda c: c.isNotNull()), 0)


@F.pandas_udf(T.StringType())
def _decoded_gb(body: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else bytes(b).decode("gb18030", "replace") for b in body], dtype="object")


@F.pandas_udf(T.BinaryType())
def encoded(text: pd.Series, charset: pd.Series) -> pd.Series:
    """Text as bytes of a known charset; what it lacks becomes UTF-8. Null for nulls."""

    def one(s, name):
        if s is None or name is None:
            return None
        try:
            return s.encode(name)
        except UnicodeEncodeError:
            return b"".join(c.encode(name, "ignore") or c.encode() for c in s)

    return pd.Series([one(s, c) for s, c in zip(text, charset, strict=True)], dtype="object")


def decoded(body: Column, content_type: Column) -> Column:
    """struct(text, charset, exact) of a page's bytes.

    Valid UTF-8 is UTF-8 whatever is declared. Else a declared Chinese charset, of the header or, without a known one,
    of the page, decides; else UTF-8 with marks for bad bytes, and exact is false. Null bytes give nulls.
    """
    valid = F.is_valid_utf8(body.cast("string"))
    declared = F.coalesce(header_charset(content_type), page_charset(body))
    chinese = ~valid & declared.isin("gbk", "gb18030")
    # Rows of other charsets are null to Python, and cost it nothing.
    gb = _decoded_gb(F.when(chinese, body))
    text = F.when(valid, body.cast("string")).when(chinese, gb).otherwise(F.make_valid_utf8(body.cast("string")))
    exact = F.when(body.isNotNull(), valid | F.coalesce(chinese & ~F.contains(gb, F.lit("�")), F.lit(False)))
    return F.struct(text.alias("text"), F.when(body.isNotNull(), F.when(chinese, declared).otherwise("utf-8")).alias("charset"), exact.alias("exact"))


def unwrapped(text: Column) -> Column:
    """What a body with the Base64 prefix holds, if that is canonical Base64 of valid UTF-8 and not empty or too long;
    else what follows the prefix. Other bodies are left as they are."""
    payload = F.substring(text, len(BASE64_PREFIX) + 1, 2**31 - 1)
    compact = F.regexp_replace(payload, r"\s+", "")
    bare = F.regexp_replace(compact, "=+$", "")
    padded = F.rpad(bare, F.ceil(F.char_length(bare) / 4).cast("int") * 4, "=")
    shaped = compact.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.char_length(compact) % 4 != 1) & (F.char_length(bare) % 4 != 1) & (F.floor(F.char_length(compact) * 3 / 4) <= MOST_DECODED)
    raw = F.when(shaped, F.try_to_binary(padded, F.lit("base64")))
    same = F.regexp_replace(F.regexp_replace(F.base64(raw), r"\s+", ""), "=+$", "") == bare
    inner = F.when(same & F.is_valid_utf8(raw.cast("string")), F.nullif(raw.cast("string"), F.lit("")))
    return F.when(F.startswith(text, F.lit(BASE64_PREFIX)), F.coalesce(inner, payload)).otherwise(text)


def body(text: Column, content_type: Column) -> Column:
    """struct(kind, text): 'json' if the body is JSON, and its type says so or it begins as an object or list; else
    'html'. A null text is empty HTML."""
    whole = X.let(F.coalesce(text, F.lit("")), unwrapped)
    plain = lambda s: F.regexp_replace(s, r"^[\s\x{FEFF}]+", "")
    asked = F.coalesce(content_type.rlike("(?i)json"), F.lit(False))
    is_json = lambda s: (asked | plain(s).rlike(r"^[{\[]")) & F.try_parse_json(plain(s)).isNotNull()
    return X.let(whole, lambda s: F.struct(F.when(is_json(s), "json").otherwise("html").alias("kind"), s.alias("text")))


def misread_ratio(line: Column) -> Column:
    """Misread characters by Chinese characters; 0 without any."""
    chinese = F.regexp_count(line, F.lit("[一-鿿]"))
    return F.when(chinese > 0, F.regexp_count(line, F.lit(f"[{_misread()}]")) / chinese).otherwise(0.0)


def is_misread(text: Column) -> Column:
    """Whether more than half of the lines that aren't blank are suspect; false for null and blank texts."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda s: F.btrim(s) != "")
    return X.let(lines, lambda a: F.size(F.filter(a, lambda s: misread_ratio(s) > SUSPECT)) * 2 > F.size(a))


@F.pandas_udf(T.StringType())
def _mended(text: pd.Series) -> pd.Series:
    bad = set(_misread())

    def ratio(s):
        chinese = sum("一" <= c <= "鿿" for c in s)
        return sum(c in bad for c in s) / chinese if chinese else 0.0

    def one(s):
        if s is None:
            return None
        again = s.encode("gbk", "ignore").decode("utf-8", "ignore")
        after = ratio(again)
        return again if again.strip() and after < ratio(s) / 2 and after < MENDED else None

    return pd.Series([one(s) for s in text], dtype="object")


def with_mended(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with out: a misread text read again, null if that doesn't make it good, so that it is better dropped;
    other texts as they are. Only misread texts go through Python; a column of the name of out is replaced."""
    x = rows.withColumn("__misread", is_misread(F.col(text)))
    x = x.withColumn("__again", _mended(F.when(F.col("__misread"), F.col(text))))
    return x.withColumn(out, F.when(F.col("__misread"), F.col("__again")).otherwise(F.col(text))).drop("__misread", "__again")
