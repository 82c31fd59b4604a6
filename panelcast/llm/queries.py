"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import ann, html, merkle, minhash, mixing, packing, quality, sharding, tokencount, tokenfile, toxicity, vectorcode, warc
from panelcast.llm.common import OWN, read, vocabulary
from panelcast.llm.sql import SQL
from panelcast.session import scratch_path

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"
#: 3 regions of 2 racks of 4 shards.
TREE = sharding.balanced_tree(3, 2, 4)


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), TREE)


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents").select("doc_id", "source"))
    own = {c: F.col(f"{OWN}{c}").alias(c) for c in ("weight", "block", "release", "deadline", "slot", "place")}
    return mixed.select("doc_id", "source", *own.values())


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), end_id=1)


def op5_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenfile.write_tokens(read(spark, sf_dir, "documents"), path, vocabulary(WORD_VOCABULARY), end_id=2)
    return tokenfile.digests(spark, path)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(read(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    return warc.page_digests(warc.read_archives(spark, path, with_payload=False))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.code_table(read(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(merkle.manifest(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hash_tree_sharding, op2_pfair_mixing, op3_minhash_near_duplicates, op4_cost_balanced_packing, op5_risk_controlled_quality,
        op6_hash_prefix_forest, op7_token_files, op8_main_text, op9_token_counts, op10_toxicity,
        op11_warc_archives, op12_vector_codes, op13_merkle_manifest,
    )
}

__all__ = ["QUERIES", "SQL"]
