"""One query for each operator of this folder, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import bpe, decontam, html, neardup, pii, quality, secrets, shard, tokenbin, toxicity
from glyphmill.shared import local_folder, ship


#: The vocabulary of the token queries: ranked byte strings.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, edits): every document that holds a passage of a benchmark item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text, n_blocks, n_kept) of every page."""
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, spans, redacted) of every document with personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.spans_of(docs, pii.train(docs))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) of every document."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.Bpe(VOCABULARY))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the compression bands keep, with their ratios."""
    docs = table(spark, sf_dir, "documents")
    return quality.compression_ratios(docs, columns=["doc_id"]).where("verdict = 'keep'")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its row number, position, shard and slot, moved into the order of positions."""
    return shard.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, first_slot, n_sequences, stride, path, bytes): the documents' token ids in training order, a file for each shard.

    The folder is the same for each run over sf_dir, so that a broken run resumes.
    """
    docs = table(spark, sf_dir, "documents")
    return tokenbin.materialise(docs, tokenbin.TokenShards(VOCABULARY), local_folder(spark, "token-shards", sf_dir)).drop("written")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_doc_id, rows): each near duplicate that goes, and the document of its group that stays."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score) of the documents called toxic by the classifier trained on the labelled ones."""
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, end, class, entropy) of every secret of every document."""
    return secrets.secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_html_extraction,
        op3_pii,
        op4_bpe_encoding,
        op5_quality_rules,
        op6_sharding,
        op7_token_binary,
        op8_minhash_near_dedup,
        op9_toxicity,
        op10_secret_scans,
    )
}

ORACLE_SQL: dict[str, str] = {"op6_sharding": shard.oracle_sql(shard.Shards())}
