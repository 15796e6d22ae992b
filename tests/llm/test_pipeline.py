from collections import Counter

import pandas as pd
from brute import WORD, jaccard as plain_jaccard, suffix_dedup as plain_dedup

import corpus_pipeline
from tomeflow.llm import tokens

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").toxic
    columns, before = docs.columns, docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        rows = list(zip(before.doc_id, before.text))
        if name == "toxicity":
            gone = set(before.doc_id) - set(after.doc_id)
            assert sum(labels.get(d, 0) == 0 for d in gone) <= 0.05 * len(before)
            assert after.merge(before, on=columns).shape[0] == len(after)
        elif name == "ngram_jaccard_join":
            want = plain_jaccard(rows, 5, 80, 100)
            assert set(after.doc_id) == {d for d in before.doc_id if want[d][1] == d} and len(after) < len(before)
        elif name == "suffix_array_dedup":
            want = plain_dedup(rows)
            assert set(after.doc_id) == {d for d, (n, gone, _, _) in want.items() if gone < n or not n}
            same = {d for d in after.doc_id if want[d][1] == 0}
            old = dict(rows)
            for d, t, n in zip(after.doc_id, after.text, after.n_chars):
                assert n == len(t) and (t == old[d]) == (d in same)
        elif name == "mixing":
            size = before.text.map(lambda t: len(WORD.findall(t)))
            times = Counter(after.doc_id)
            assert max(times.values()) <= 2
            total = sum(times[d] * n for d, n in zip(before.doc_id, size))
            assert abs(total - 1.5 * size.sum()) < 0.1 * size.sum()
        else:
            enc = tokens.Encoder(tokens.default_tokenizer())
            n = {d: len(b) // 4 + 1 for d, b in zip(before.doc_id, enc.encode(before.text.tolist()))}
            assert after.length.sum() == sum(n[d] for d in before.doc_id)
            assert after.groupby("sequence_id").length.sum().max() <= 2048
        before = after


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50
