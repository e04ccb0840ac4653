"""The corpus pipeline: language ID, near-dedup, mixing to target weights, SentencePiece coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import langid, mixing, neardup, spbpe
from labelmill.llm.common import discard, land

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier does not reject; it is fitted on a bounded sample of labelled rows."""
    return langid.identify(docs, langid.fit(docs)).filter(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are at least 0.8 alike: that of the smallest doc_id.

    Rows that repeat a doc_id stay or go together; rows without doc_id stay."""
    found = neardup.near_duplicates(docs, width=5, percent=80)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that raking to source, language and topic shares gives."""
    return mixing.mixed(docs).filter("sampled").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of pieces and digests of the pieces and of the decoded text."""
    from labelmill.llm.queries import tokenizer

    return spbpe.coded_digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("language_id", languages), ("minhash_near_dedup", near_duplicates), ("mix_to_targets", mix), ("sentencepiece", encode)]

#: The first stage's classifier, and the merges of the last, are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = land(stage(spark, docs, sf_dir))
        discard(docs)  # what the stage before left
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
