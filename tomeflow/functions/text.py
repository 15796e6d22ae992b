"""Column functions on strings, urls and numbers; all built in, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms and the plain characters that they fold to.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
#: Chinese digits and their values, zero first.
DIGITS = "零一二三四五六七八九"


def fold_width(c: Column) -> Column:
    return F.translate(c, WIDE, PLAIN)


def identity_title(c: Column) -> Column:
    """Width-folded, space-trimmed, one layer of title brackets removed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.btrim(fold_width(c)), r"^《([^\n]+)》$", "$1")))


def identity_author(c: Column) -> Column:
    return F.lower(F.btrim(fold_width(c)))


def loose_key(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(fold_width(c)), r"[^\p{L}\p{N}]", "")


def clip(c: Column, most: int) -> Column:
    """At most so many code points, the last an ellipsis if any were cut."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def squash_controls(c: Column) -> Column:
    """Control characters to spaces, runs of spaces to one."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), " +", " "))


def btrim_blanks(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s\x{A0}\x{3000}\x{FEFF}]+|[\s\x{A0}\x{3000}\x{FEFF}]+$", "")


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.btrim(c), F.lit("")) for c in cols])


def escape_like(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def url_normal(c: Column) -> Column:
    """Trimmed, without fragment and without a slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.btrim(c), "#.*$", ""), "/+$", "")


def url_host(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(F.btrim(c), r"^(?i)[a-z][a-z0-9+.-]*://([^/?#:@]+)", 1), F.lit("")))


def url_station(c: Column) -> Column:
    """Host without www. and m. before it."""
    return F.regexp_replace(url_host(c), r"^(www\.|m\.)+", "")


def backoff(n: Column, base: int, cap: int, factor: int = 2) -> Column:
    """base * factor ** n, at most cap."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(float(factor)), F.least(n, F.lit(30)).cast("double"))).cast("long")


def fail_count(c: Column) -> Column:
    """The number in fail_count:<n>:rest, 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"^fail_count:(\d+):", 1).try_cast("int"), F.lit(0))


def set_fail_count(n: Column, rest: Column) -> Column:
    return F.concat(F.lit("fail_count:"), n.cast("string"), F.lit(":"), rest)


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often, or inside lambdas, it stands there."""
    return F.get(F.transform(F.array(value), use), 0)


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct runs of n letters or digits of the loose key; none if it is shorter."""
    chars = F.filter(F.split(F.coalesce(loose_key(c), F.lit("")), ""), lambda x: x != "")
    runs = lambda k: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(k) - n), lambda i: F.array_join(F.slice(k, i + 1, F.lit(n)), "")))
    return let(chars, lambda k: F.when(F.size(k) >= n, runs(k)).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def chinese_number(c: Column) -> Column:
    """Value of a number below 10 000 in Chinese or Arabic digits; null for anything else."""
    digit = lambda x: F.instr(F.lit(DIGITS), F.when(x == "两", "二").otherwise(x)) - 1
    place = lambda unit, value: F.when(F.instr(c, unit) > 0, F.when(F.regexp_extract(c, f"([一二两三四五六七八九])?{unit}", 1) == "", 1).otherwise(digit(F.regexp_extract(c, f"([一二两三四五六七八九]){unit}", 1))) * value).otherwise(0)
    ones = F.regexp_extract(c, "([零一二两三四五六七八九])$", 1)
    total = place("千", 1000) + place("百", 100) + place("十", 10) + F.when(ones == "", 0).otherwise(digit(ones))
    shape = c.rlike("^([一二两三四五六七八九]?千)?零?([一二两三四五六七八九]?百)?零?([一二两三四五六七八九]?十)?[一二两三四五六七八九]?$|^零$") & (c != "")
    return F.coalesce(c.try_cast("int"), F.when(shape, total)).cast("int")
