"""Urls: made absolute as browsers do, percent-encoded in a charset, and checked against a policy."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemes with a host and their ports; what is percent-encoded in each part of a url, beside controls
#: and what isn't ASCII; what no host holds; what stays as it is in a query's component and in a form.
PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
IN_PATH, IN_QUERY, IN_FRAGMENT, IN_USER = set(' "#<>?`{}'), set(" \"#<>'"), set(' "<>`'), set(' "#<>?`{}/:;=@[\\]^|')
NO_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
COMPONENT = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.!~*'()")
FORM = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-*_")
MOST_CHARS = 2048

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_DOT = re.compile(r"(?:\.|%2e)", re.IGNORECASE)


def _percent(s: str, chosen: set) -> str:
    return "".join(c if "\x20" <= c < "\x7f" and c not in chosen else "".join(f"%{b:02X}" for b in c.encode()) for c in s)


def _ipv4(host: str) -> str | None:
    """Dotted form of a host that ends in a number, written in any of the accepted ways; ValueError if it is none."""
    labels = host[:-1].split(".") if host.endswith(".") else host.split(".")
    if not re.fullmatch(r"[0-9]+|0[xX][0-9A-Fa-f]*", labels[-1]):
        return None
    if len(labels) > 4:
        raise ValueError("not an address")
    n = [int(x[2:] or "0", 16) if x[:2].lower() == "0x" else int(x, 8) if len(x) > 1 and x[0] == "0" else int(x) for x in labels]
    if any(x > 255 for x in n[:-1]) or n[-1] >= 256 ** (5 - len(n)):
        raise ValueError("not an address")
    value = n[-1] + sum(x * 256 ** (3 - i) for i, x in enumerate(n[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _host(raw: str) -> str:
    if raw.startswith("["):
        if not re.fullmatch(r"\[[0-9A-Fa-f:.]+\]", raw):
            raise ValueError("not an address")
        return raw.lower()
    host = unquote_to_bytes(raw).decode().lower()
    if not host.isascii():
        host = host.encode("idna").decode()
    if not host or NO_HOST.search(host):
        raise ValueError("not a host")
    return _ipv4(host) or host


def _authority(raw: str, scheme: str) -> str:
    user, at, rest = raw.rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", rest)
    if m is None or m[2] and int(m[2]) > 65535:
        raise ValueError("not a port")
    name, colon, word = user.partition(":")
    known = _percent(name, IN_USER) + (":" + _percent(word, IN_USER) if word else "")
    port = f":{int(m[2])}" if m[2] and int(m[2]) != PORTS[scheme] else ""
    return (known + "@" if known else "") + _host(m[1]) + port


def _path(raw: str) -> str:
    """A path from its root, without steps to itself or to above."""
    out: list[str] = []
    steps = raw.split("/")
    for i, step in enumerate(steps):
        plain, last = _DOT.sub(".", step), i == len(steps) - 1
        if plain == "..":
            del out[-1:]
        elif plain != ".":
            out.append(_percent(step, IN_PATH))
            continue
        if last:
            out.append("")
    return "/" + "/".join(out)


def _cut(s: str) -> tuple[str, str | None, str | None]:
    """(before, query, fragment), null where there is none."""
    s, hash_, fragment = s.partition("#")
    s, mark, query = s.partition("?")
    return s, query if mark else None, fragment if hash_ else None


def absolute(value: str, base: str | None) -> str | None:
    """value as a url, read from base where it is relative; None if it is empty or no url."""
    value = re.sub(r"[\t\n\r]", "", value.strip("".join(map(chr, range(33))) + " 　﻿"))
    if not value:
        return None
    try:
        return _absolute(value, base)
    except (ValueError, UnicodeError):
        return None


def _absolute(value: str, base: str | None) -> str | None:
    m = _SCHEME.match(value)
    scheme = m[1].lower() if m else None
    if scheme and scheme not in PORTS:
        head, _, fragment = value[m.end() :].partition("#")
        return f"{scheme}:{_percent(head, set())}" + ("#" + _percent(fragment, IN_FRAGMENT) if _ else "")
    origin = None
    if base is not None and (origin := absolute(base, None)) is not None and origin.split(":", 1)[0] not in PORTS:
        return None
    body, query, fragment = _cut(value[m.end() :] if m else value)
    body = body.replace("\\", "/")
    here = origin.split(":", 1)[0] if origin else None
    if scheme and not (scheme == here and not body.startswith("/")):
        host, slash, path = body.lstrip("/").partition("/")
        site, path = f"{scheme}://{_authority(host, scheme)}", _path(path)
    elif origin is None:
        return None
    else:
        old, old_query, _ = _cut(origin)
        start = old.index("/", len(here) + 3)
        site, old_path = old[:start], old[start:]
        if body.startswith("//"):
            host, slash, path = body.lstrip("/").partition("/")
            site, path = f"{here}://{_authority(host, here)}", _path(path)
        elif body.startswith("/"):
            path = _path(body[1:])
        elif body:
            path = _path(old_path[1 : old_path.rindex("/") + 1] + body)
        else:
            path, query = old_path, old_query if query is None else query
    return site + path + ("" if query is None else "?" + _percent(query, IN_QUERY)) + ("" if fragment is None else "#" + _percent(fragment, IN_FRAGMENT))


@F.pandas_udf(T.StringType())
def absolute_url(value: pd.Series, base: pd.Series) -> pd.Series:
    """A link as a whole url, by the page that it stands on; null for what is no url. Null bases take whole urls only."""
    return pd.Series([None if v is None else absolute(v, b) for v, b in zip(value, base, strict=True)], dtype="object")


def percent_encoded(s: str, charset: str, form: bool = False) -> str:
    """A query's text by bytes of a charset; characters that it lacks are UTF-8. A form's blanks are plus signs."""

    def one(c: str) -> str:
        if c in (FORM if form else COMPONENT):
            return c
        if form and c == " ":
            return "+"
        try:
            raw = c.encode("gbk" if charset == "gb18030" else charset)
        except UnicodeEncodeError:
            raw = c.encode()
        return "".join(f"%{b:02X}" for b in raw)

    return "".join(map(one, s))


@F.pandas_udf(T.StringType())
def query_text(c: pd.Series, charset: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or e is None else percent_encoded(s, e, bool(f)) for s, e, f in zip(c, charset, form, strict=True)], dtype="object")


def refusal(url: Column, hosts: list[str] | None = None) -> Column:
    """Why a url isn't fetched: 'characters', 'scheme', 'authority', 'address', 'host'; null if it may be.

    It must be https, at most 2,048 characters without blanks and controls, on the usual port, without a user, and on
    a name, one of the hosts where they are given. Null urls are refused for their characters.
    """
    authority = F.regexp_extract(url, "(?i)^https://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, ":443$", ""))
    numeric = host.rlike(r"^(?:.*\.)?(?:[0-9]+|0x[0-9a-f]*)\.?$") | F.startswith(host, F.lit("["))
    return (
        F.when(url.isNull() | (url == "") | (F.char_length(url) > MOST_CHARS) | url.rlike(r"[\x00-\x20\x7f\\]"), "characters")
        .when(~url.rlike("(?i)^https://"), "scheme")
        .when((host == "") | F.contains(authority, F.lit("@")) | (F.contains(host, F.lit(":")) & ~F.startswith(host, F.lit("["))), "authority")
        .when(numeric, "address")
        .when(~host.isin(*hosts) if hosts is not None else F.lit(False), "host")
    )
