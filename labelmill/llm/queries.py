"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, convrepair, htmltext, idfile, langid, merkle, mixing, neardup, packing, shard, spbpe, urlfilter, vecdedup
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard.shard_rows(table(spark, sf_dir, "documents"), "doc_id", shards=8)
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spbpe.coded_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_segmented_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_layout_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def op3_projection_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_sorted_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.linked_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op7_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "topic", "n_words", F.round("chance", 6).alias("chance"), "sampled")


def op8_context_mixing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.read_ids(idfile.write_ids(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repaired_conversations(table(spark, sf_dir, "conversations"))


def op12_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hypergeometric_shards": op1_hypergeometric_shards,
    "op2_segmented_url_filter": op2_segmented_url_filter,
    "op3_projection_forest_neighbours": op3_projection_forest_neighbours,
    "op4_layout_html_text": op4_layout_html_text,
    "op5_nearest_centroid_language": op5_nearest_centroid_language,
    "op6_sorted_projection_dedup": op6_sorted_projection_dedup,
    "op7_mix_to_targets": op7_mix_to_targets,
    "op8_context_mixing_ids": op8_context_mixing_ids,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_grouping_packing": op12_grouping_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op7_mix_to_targets": mixing.mixed_sql(),
}
