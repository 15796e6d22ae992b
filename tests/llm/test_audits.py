"""Filter audit, ranked search and fingerprints against plain versions of their contracts."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from brute import WORD, lower

from tomeflow.llm import filteraudit, fuzzyhash, lexical, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def sql_rows(name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    return [c[0] for c in got.description], sorted(got.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    columns, want = sql_rows(name)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want and want


def filter_rows(docs, labels):
    """Rows of the audit; docs: [(doc_id, text, lang)], labels: [(doc_id, quality, toxic)]; a null id is the smallest."""
    key = lambda d: (d is not None, d)
    least, marks = {}, {}
    for d, t, _ in docs:
        t = t or ""
        least[t] = min(least.get(t, d), d, key=key)
    for d, q, x in labels:
        old = marks.get(d, (False, False))
        marks[d] = (old[0] or q == 1, old[1] or x == 1)
    rows = []
    for d, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": key(least[t]) < key(d)}
        rows.append((part or "", fails, marks.get(d, (False, False)) if d is not None else (False, False)))
    out, removed_by = {}, {}
    for part in {r[0] for r in rows}:
        for o in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(o, 1):
                gone = [r for r in left if r[1][f]]
                failing = [r for r in rows if r[0] == part and r[1][f]]
                left = [r for r in left if not r[1][f]]
                alone = sum(sum(r[1].values()) == 1 for r in failing)
                out[part, "".join(o), step] = (len(left), len(gone), len(failing) - len(gone), alone, sum(r[2][0] for r in gone), sum(r[2][1] for r in gone))
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filters_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (None, long, "de"), (3, None, None), (4, "", ""), (5, "A B c # d", "en"), (6, "word " * 20_000, "en"),
        (7, long + " $", "fr"), (8, "É" * 50 + "AAAAAA", "fr"), (1, long, None), (9, " \t\n", "en"),
    ]
    labels = [(1, 1, 0), (2, None, 1), (2, 1, None), (None, 1, 1), (6, 0, 0), (99, 1, 1)]
    d = spark.createDataFrame([(*r, 7, "x") for r in docs], "doc_id long, text string, lang string, n int, part string")
    x = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filteraudit.audit_filters(d, x).collect()}
    assert got == filter_rows(docs, labels)
    assert filteraudit.audit_filters(d.where("false"), x).count() == 0
    assert filteraudit.audit_filters(d, x.where("false")).count() == len(got)


def test_filters_at_scale_of_parts(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "PARTS_HELD", 3)
    d = spark.range(0, 40, 1, 4).selectExpr("id doc_id", "concat('a b ', id % 9) text", "cast(id % 13 as string) lang")
    x = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in d.collect()]
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filteraudit.audit_filters(d, x).collect()}
    assert got == filter_rows(rows, [])


def search_rows(docs, items, k):
    terms = [(d, TERM.findall(lower(t or ""))) for d, t in docs]
    terms = [(d, t) for d, t in terms if t]
    n_docs, n_terms, df = len(terms), sum(len(t) for _, t in terms), {}
    for _, t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        q = set(TERM.findall(lower(text or "")))
        scored = []
        for d, t in terms:
            m, s = 100 - 50 + 50 * len(t) * n_docs // n_terms, 0
            for w in q:
                if tf := t.count(w):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if s:
                scored.append((-s, d is not None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("postings, block", [(40, 3), (2_000_000, 10_000)])
def test_search(spark, monkeypatch, postings, block):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(lexical, "FIRST_DEPTH", 2)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "ÄB", "x-y", "漢字", "the", "the", "THE"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(150)]
    docs += [(200 + i, "the same text") for i in range(60)] + [(300, None), (301, ""), (302, "--"), (None, "the w1"), (1, "the w1"), (303, "w2 " * 20_000)]
    items = [(1, "w1 w2 w3 the"), (2, "same"), (3, None), (4, "nothing-here"), (5, "ünï ÄB äB 漢字 X"), (5, "w7"), (None, "w9 w9"), (6, " ".join(words))]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, item int").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n int")
    got = sorted((tuple(r) for r in lexical.search(d, q, 7).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == search_rows(docs, items, 7)
    assert lexical.search(d.where("false"), q, 7).count() == 0 and lexical.search(d, q.where("false"), 7).count() == 0


def test_search_stops_early():
    """A list of one rare term among thousands of documents: few of them are read."""
    n = 5000
    ones = np.ones(n, np.int64)
    s = lexical.Shard(np.arange(n), np.arange(n, 0, -1), ones, 0 * ones, ones, np.array([7]), n, n)
    score, ids = s.search(0, np.array([0]), 5, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert ids.tolist() == list(range(n - 1, n - 6, -1)) and (s.seen == 0).sum() == lexical.FIRST_DEPTH


def plain_fingerprint(text):
    """Byte by byte, in whole numbers."""
    full = 0xFFFFFFFF

    def mixed(h):
        h = (h ^ h >> 16) * 0x7FEB352D & full
        h = (h ^ h >> 15) * 0x846CA68B & full
        return h ^ h >> 16

    hashes = []
    for i in range(len(text)):
        h = 0
        for k in range(i - fuzzyhash.WINDOW + 1, i + 1):
            h = (h * 0x2C9277B5 + (int(fuzzyhash._BYTES[text[k]]) if k >= 0 else 0)) & full
        hashes.append(mixed(h))
    for bits in range(2, 34):
        if sum(h & (1 << bits) - 1 == (1 << bits) - 1 for h in hashes) <= 64 or bits == 33:
            break
    out = [str(1 << bits)]
    for b in (bits, bits + 1):
        sig, held, any_ = "", 0, False
        for h in hashes:
            held, any_ = held + h & full, True
            if h & (1 << b) - 1 == (1 << b) - 1:
                sig, held, any_ = sig + chr(fuzzyhash.ALPHABET[mixed(held) >> 26]), 0, False
        out.append(sig + (chr(fuzzyhash.ALPHABET[mixed(held) >> 26]) if any_ else ""))
    return ":".join(out)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


def test_fingerprints_of_bytes(monkeypatch):
    rng = random.Random(2)
    texts = [b"", b"a", b"a" * 3000, bytes(rng.choices(range(256), k=4000)), "漢字 and Ünï ".encode() * 40, bytes(rng.choices(b"ab ", k=700))]
    want = [plain_fingerprint(t) for t in texts]
    assert [fuzzyhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(fuzzyhash, "SLICE", 97)
    assert [fuzzyhash.fingerprint(t) for t in texts] == want
    assert all(len(w.split(":")[1]) <= 65 for w in want)


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 70))) for _ in "ab")
        assert fuzzyhash.edit_distance(a, b) == plain_distance(a, b)


@pytest.mark.parametrize("rows", [None, 0, 1])
def test_fingerprints(spark, rows):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzñ漢", k=rng.randint(2, 9)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(30, 400)))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "x"), (73, docs[5][1]), (74, docs[5][1]), (None, "null id"), (5, "second"), (80, "long " * 300_000), (81, docs[7][1])]
    docs = docs[:rows] if rows is not None else docs
    d = spark.createDataFrame([(*r, "e", 3) for r in docs], "doc_id long, text string, edge string, part int").repartition(3)
    got = fuzzyhash.fingerprint_documents(d).collect()
    order = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, changed, its = (fuzzyhash.fingerprint(x.encode()) for x in (t, edited, following))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, fuzzyhash.likeness(own, changed), fuzzyhash.likeness(own, its)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_likeness_tells_halves_from_others(spark):
    got = queries.op13_fingerprints(spark, "/root/testdata/sf0.01").toPandas()
    long = got[got.n_chars >= 200]
    assert (long.near_edited > 0.3).mean() > 0.97 and long.near_edited.mean() > 0.5
    assert (long.near_next < 0.3).mean() > 0.9
    assert ((got.near_edited >= 0) & (got.near_edited <= 1) & (got.near_next >= 0) & (got.near_next <= 1)).all()
