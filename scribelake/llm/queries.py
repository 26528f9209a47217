"""The registered queries of the corpus operators, over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.llm import audit, bpe, lattice, lines, media, mixing, pii, quality, resampling, sharding, simhash, sketch, toxicity
from scribelake.llm.common import documents

SHARDS = 24


def public_bpe() -> tuple[str, str]:
    """File and pattern of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op3_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice.score_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_peak_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op6_bitmap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), *public_bpe())


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), sharding.Tree.even(SHARDS))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op9_bloom_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_documents(documents(spark, sf_dir))


def op10_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.pseudonymise(documents(spark, sf_dir), key=pii.session_key(spark))
    count = lambda kind: F.size(F.filter("pii_values", lambda v: v["kind"] == kind)).alias(f"n_{kind}")
    return rows.select("doc_id", "text", F.size("pii_values").alias("n_values"), *map(count, pii.KINDS))


def op11_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op12_duckdb_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_lattice_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_ball, op2_co_training, op3_subword_lattice, op4_boosted_toxicity, op5_peak_pairs, op6_bitmap_bpe, op7_hash_tree, op8_pareto_mix, op9_bloom_sketch, op10_feistel, op11_line_field, op12_duckdb_resample, op13_lattice_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op8_pareto_mix": mixing.mix_sql(), "op12_duckdb_resample": resampling.resample_sql(), "op13_lattice_audit": audit.audit_sql()}
