"""A corpus pipeline: toxic documents go, then near copies, then repeated passages; sources are mixed to target
weights and the mix is packed into sequences. Each stage is written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomeflow.llm import jaccard, mixing, packing, suffixdedup, toxicity
from tomeflow.llm.common import free_heaps, save, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those scored 0.5 or more. A null or empty text scores as one without matches, so it stays; rows
    that repeat an id or a text are scored alike; an empty table stays empty."""
    free_heaps(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): that of the smallest id. Null and empty texts have
    no words, are in no group and stay; a null id is the smallest; rows that repeat the kept id stay with it."""
    free_heaps(spark)
    return jaccard.keep_first_of_groups(docs, words=5, num=80, den=100)


def drop_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without bytes covered by 100 bytes that also start earlier; what loses all its text goes. Null and empty
    texts stay, as empty ones; of rows that repeat an id the first in the table is the earlier one."""
    free_heaps(spark)
    return suffixdedup.drop_repeated_text(docs, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it. Null and empty texts have no words and aren't
    taken; a null source is a source of its own; rows equal in all columns are taken equally often."""
    free_heaps(spark)
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequences that they fill. A null text is the end token alone; rows that
    repeat an id are packed each; an empty table has no pieces."""
    free_heaps(spark)
    return packing.pack_documents(docs, 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_text),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The stages of toxicity and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"stage-{name}")
    return docs
