import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from brute import fold, quality

from tomeflow.llm import mixing, packing, quality as quality_op, queries, sharding, tokens, tokenstore, toxicity

SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, None), (2, ""), (3, " a  b\tc\n\nd e f 　 g "), (4, "The <|endoftext|> end"), (5, "word " * 3000),
    (6, "Ünï 漢字 don't 123 #%& x"), (7, "word " * 3000), (8, "\x00a \x00b"), (9, "a\nb c\r\nd"), (10, "x" * 9000),
]


def docs_frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size int")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def documents(sf=SF):
    return pd.read_parquet(f"{sf}/documents.parquet")


def test_encoder_equals_tokenizer(tokenizer):
    texts = documents().text.tolist() + [t or "" for _, t in TEXTS]
    got = tokens.Encoder(tokens.default_tokenizer()).encode(texts)
    for t, b in zip(texts, got):
        assert b == ids_of(tokenizer, t)[:-1].tobytes(), t[:80]


@pytest.mark.parametrize("own", [False, True])
def test_packing(spark, tokenizer, own):
    if own:
        docs, got = dict(TEXTS), packing.pack_documents(docs_frame(spark)).toPandas()
    else:
        docs, got = dict(documents()[["doc_id", "text"]].to_numpy()), queries.op1_best_fit_packing(spark, SF).toPandas()
    total = 0
    for d, g in got.sort_values("piece").groupby("doc_id"):
        ids = ids_of(tokenizer, docs[d])
        total += len(ids)
        assert g.length.sum() == len(ids) and (g.start.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()
        assert (g.length.iloc[1:] == 2048).all() and (len(ids) > 2048 or len(g) == 1)
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert set(got.doc_id) == set(docs)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all() and g.length.sum() <= 2048
    if not own:
        assert got.sequence_id.nunique() <= -(-total // 2048) + 2


def test_best_two_fit_replaces_the_smallest():
    bins = packing.best_two_fit([6, 3, 2, 2], 10)
    assert sorted(map(sorted, bins)) == [[0, 2, 3], [1]]
    rng = np.random.default_rng(1)
    n = rng.integers(1, 60, 500).tolist()
    bins = packing.best_two_fit(n, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and max(sum(n[i] for i in b) for b in bins) <= 100
    assert len(bins) <= -(-sum(n) // 100) + 1


def test_sequences_hold_the_ids(spark, tokenizer):
    pieces = packing.cut_pieces(tokens.encode_documents(docs_frame(spark), "doc_id", "text"), "doc_id", 2048).cache()
    got = packing.sequences(pieces, packing.pack(pieces.drop("ids"), "doc_id", 2048), "doc_id").toPandas()
    assert sum(map(len, got.ids)) == 4 * sum(len(ids_of(tokenizer, t)) for _, t in TEXTS)


def test_sharding(spark):
    got, docs = queries.op3_sharding(spark, SF).toPandas(), documents().set_index("doc_id").text
    n = got.groupby("shard").size()
    assert len(got) == len(docs) and n.max() - n.min() <= 1 and set(n.index) == set(range(24))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert all(s == len(docs[d].encode()) + 8 and c == zlib.crc32(docs[d].encode()) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32))


def test_sharding_moves_little_with_slack(spark):
    rows = spark.range(20000).withColumnRenamed("id", "k")
    at = [sharding.shard_rows(rows, "k", n, 64, 0.25).toPandas().set_index("k").shard for n in (24, 25)]
    assert (at[0] != at[1].reindex(at[0].index)).mean() < 0.25
    assert at[0].value_counts().max() <= 20000 * 1.25 / 24 + 1


def test_sharding_odd_rows(spark):
    rows = spark.createDataFrame([(None, 1), (5, 2), (5, 3), (None, 4)], "k long, size int")
    assert sorted(sharding.shard_rows(rows, "k", 2).toPandas().shard) == [0, 0, 1, 1]
    assert sharding.shard_rows(rows.limit(0), "k", 2).count() == 0


def test_quality(spark):
    text = dict(documents()[["doc_id", "text"]].to_numpy())
    for r in queries.op5_quality_rules(spark, SF).toPandas().itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality(text[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_small(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a a"), (5, "a b c d e f a b c d e"), (6, "x y z\n\nx y z\n" * 3), (7, "a b c d e a b c d e"), (8, "q"), (9, "a b c d e")]
    got = quality_op.clean_lines(docs_frame(spark, rows)).toPandas()
    for r in got.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality(dict(rows)[r.doc_id]), r
    lines = "This is a sentence of plain words that ends, as it should, with a point.\nHome | About | Contact | Help\nAll rights reserved.\n"
    got = quality_op.clean_lines(docs_frame(spark, [(1, lines)])).first()
    assert got.cleaned_text == lines.split("\n")[0] and got.lost_chars == 49
    reasons = quality_op.removed_lines(docs_frame(spark, [(1, lines)]), "doc_id").toPandas().reason.tolist()
    assert sorted(reasons) == ["boilerplate", "navigation"]


def test_token_store(spark, tokenizer, tmp_path):
    for frame, docs in ((docs_frame(spark), dict(TEXTS)), (spark.read.parquet(f"{SF}/documents.parquet"), dict(documents()[["doc_id", "text"]].to_numpy()))):
        path = str(tmp_path / f"s{len(docs)}")
        tokenstore.write_tokens(frame, path, segment_tokens=5000)
        got = tokenstore.read_tokens(spark, path).toPandas().sort_values("doc_id")
        at = 0
        for r in got.itertuples():
            ids = ids_of(tokenizer, docs[r.doc_id])
            assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids.tobytes())
            at += len(ids)
        assert got.doc_id.tolist() == sorted(docs)
    assert tokenstore.store_and_read(docs_frame(spark).limit(0)).count() == 0


def test_segment_random_access():
    rng = np.random.default_rng(0)
    ids = (2.0 ** rng.uniform(0, 31.9, 3000)).astype("<u4")
    s = tokenstore.Segment(tokenstore.write_segment([1, 2], [ids[:7].tobytes(), ids[7:].tobytes()], 9))
    assert s.before == 9 and s.ends.tolist() == [7, 3000] and len(s.levels) == 4
    assert [s.token(i) for i in range(3000)] == ids.tolist()
    for a, b in rng.integers(0, 3001, (200, 2)):
        assert s.slice(a, b).tolist() == ids[a:b].tolist()


def test_toxicity_held_out(spark):
    got = queries.op8_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").merge(got, on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all(h == (fold(d, 5) == 0) for d, h in zip(got.doc_id, got.held_out))
    held = labels[labels.held_out]
    assert (held.predicted[held.toxic == 1] == 1).mean() > 0.6 and (held.predicted[held.toxic == 0] == 1).mean() < 0.02


def test_automaton():
    a = toxicity.LexiconAutomaton(["idiot", "scum"], ["lowei"])
    want = {"idiot": 0, "idot": 2, "idiiot": 2, "idyot": 2, "diot": 2, "idiots": 2, "idiotss": -1, "idiom": 2, "scum": 0, "scun": -1, "loweixyz": 1, "lowe": -1, "": -1, "the": -1}
    assert {w: a.match(w) for w in want} == want


def test_toxicity_context_and_empty(spark):
    docs = docs_frame(spark, [(1, "you idiot go"), (2, 'he said the word "idiot" is a slur'), (3, None), (4, "")])
    f = toxicity.score_column(toxicity.Model(["idiot"], [], -3.0, [6.0, 1.0, 5.0, 1.0, 4.0, 0.5]))
    got = {r.doc_id: r.s for r in docs.select("doc_id", f("text").alias("s")).collect()}
    assert got[1] > 0.5 > got[2] > got[3] == got[4]
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, nothing).count() == 4


def test_toxicity_learns_beside_copies(spark):
    """Copies of one toxic text are most rows; few other texts hold a rare term, always after the same word."""
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    copied = "some long copied passage about nothing in particular " + text(20)
    toxic = [copied] * 2500 + [f"{text(6)} you {w} {text(6)}" for w in ("blorpface", "zagnut") for _ in range(15)]
    clean = [text(14) + " you " + text(3) for _ in range(400)] + [copied + " and more " + text(4)] * 3
    rows = list(enumerate(toxic + clean))
    docs = docs_frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    found = toxicity.LexiconAutomaton(model.terms, model.stems)
    assert found.match("blorpface") >= 0 and found.match("zagnut") >= 0
    assert all(found.match(w) < 0 for w in ("passage", "particular", "you"))
    new = docs_frame(spark, [(9001, f"{text(5)} you blorpface {text(5)}"), (9002, text(12))])
    assert [r.doc_id for r in new.where(toxicity.score_column(model)("text") >= 0.5).collect()] == [9001]


def test_mixing(spark):
    got, docs = queries.op9_mixing(spark, SF).toPandas(), documents()
    words = docs.text.str.findall(r"[^\x20\x09-\x0D]+").str.len()
    assert got.set_index("doc_id")["size"].to_dict() == dict(zip(docs.doc_id, words))
    assert (got.taken <= 2 * got["size"]).all()
    x = got.merge(docs[["doc_id", "source"]], on="doc_id")
    for _, g in x.groupby("source"):
        assert g.source_size.iloc[0] == g["size"].sum() and abs(g.taken.sum() - g.target.iloc[0]) <= 64 + 0.5
    assert abs(x.groupby("source").target.first().sum() - 1.5 * words.sum()) < 1e-6 * words.sum()
    again = queries.op9_mixing(spark, SF).toPandas()
    assert got.sort_values("doc_id").to_numpy().tolist() == again.sort_values("doc_id").to_numpy().tolist()


def test_mixing_odd_rows(spark):
    rows = spark.createDataFrame([(1, 10, None), (2, 0, "a"), (3, 100, "b"), (3, 100, "b"), (4, 5, "a")], "k long, n long, s string")
    got = mixing.mix(rows, "k", "n", "s").toPandas()
    assert len(got) == 5 and got[got.k == 2].taken.item() == 0 and (got.taken <= 2 * got.n).all()
    assert mixing.mix(rows.limit(0), "k", "n", "s").count() == 0


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, 200 * 0 + 250 * 2 / 3, 250 / 3]
    assert mixing.water_fill([], [], 0, 2) == []


def test_weights_converge_where_labels_part():
    from tomeflow.llm import toxicity

    bias, weights = toxicity._fit_weights([([0, 0, 0, 0, 0, 0], 0, 14000), ([3, 0, 0, 0, 0, 0], 1, 1500), ([1, 0, 0, 0, 1, 0], 1, 200), ([0, 0, 0, 0, 1, 0], 0, 50)])
    assert -100 < bias < 0 and all(abs(w) < 100 for w in weights)
    assert bias + 3 * weights[0] > 0 and bias + weights[0] + weights[4] > 0 > bias + weights[4]


def test_any_extra_columns(spark):
    """Columns of the input with names that the operators use stay what they are."""
    names = ["__r", "__cell", "__rank", "__no", "__t", "__words", "target", "__h", "__all"]
    x = spark.createDataFrame([(i, f"w{i} b c. d" * 5, i % 3, *[100 * i + k for k in range(len(names))]) for i in range(20)], ["doc_id", "text", "n", *names])
    before = {r.doc_id: r for r in x.collect()}
    for out in (sharding.shard_rows(x, "doc_id", 3), quality_op.clean_lines(x), mixing.mix(x.withColumn("source", F.lit("s")), "doc_id", "n", "source")):
        assert len(out.columns) == len(set(out.columns))
        rows = out.collect()
        assert len(rows) == 20
        for r in rows:
            assert all(r[c] == before[r.doc_id][c] for c in x.columns if c != "target" or c not in out.columns or "source_size" not in out.columns)


def test_token_store_keeps_null_ids(spark, tokenizer):
    got = tokenstore.store_and_read(docs_frame(spark, [(3, "b c"), (None, "a"), (3, "b c"), (-5, None)])).toPandas()
    assert got.sort_values("start").doc_id.fillna(0).tolist() == [0, -5, 3, 3]
    assert got.sort_values("start").start.tolist() == np.concatenate([[0], got.sort_values("start").n_tokens.cumsum()[:-1]]).tolist()


def test_very_long_texts(spark, tokenizer):
    """12 MB of words, and a word of 3 MB, through the operators that cut texts."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 5000, 2_000_000)]
    rows = [(1, " ".join(words)), (2, "x" * 3_000_000), (3, "a b\n" * 4)]
    enc = tokens.Encoder(tokens.default_tokenizer())
    for (_, t), b in zip(rows[::2], enc.encode([t for _, t in rows])[::2]):
        assert b == ids_of(tokenizer, t)[:-1].tobytes()
    automaton = toxicity.LexiconAutomaton(["w4999"], [])
    assert toxicity.features(rows[0][1], automaton, {})[0] == 3
    assert sum(e - b for _, b, e in toxicity._stretches(rows[0][1])) == len(words)
    got = {r.doc_id: r for r in quality_op.clean_lines(docs_frame(spark, rows)).select("doc_id", "n_words", "word_chars").collect()}
    assert got[1].n_words == len(words) and got[2].word_chars == 3_000_000
