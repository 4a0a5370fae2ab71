"""The registered queries of these operators, over whole tables with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import (
    exact_dedup,
    fingerprints,
    hard_negatives,
    mixing,
    near_dedup,
    packing,
    quality,
    secrets_scan,
    sharding,
    substring_dedup,
    token_alignment,
    token_files,
    url_filter,
)
from wardline.llm.common import scratch_dir
from wardline.llm.oracle import oracle_sql as oracle_sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie on this machine and its workers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprinted(documents(spark, sf_dir))
    return rows.withColumns(
        {name: fingerprints.as_text(name) for name in ("fingerprint", "edited_fingerprint")}
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(
        documents(spark, sf_dir), scratch_dir(spark), tokenizer_path("word_bpe_49k.json"), end_id=2
    )
    return token_files.read_token_files(manifest)


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.contiguous_shards(documents(spark, sf_dir))
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets_scan.scan_secrets(documents(spark, sf_dir))
    return spans.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
        "n_entropy",
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.similar_components(documents(spark, sf_dir))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(documents(spark, sf_dir), labels)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(documents(spark, sf_dir))
    return rows.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest", "h")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, sf_dir))


#: fixed values: the rules that the query applies
URL_RULES = (
    "allow org/",
    "block example.org/es/",
    "block example.org/en/1",
    "allow com/fr/",
    "block com/de/",
)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judged(pages, [url_filter.rule_of(text) for text in URL_RULES])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), "id % 100 = 0")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(
        documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_token_files": op2_token_files,
        "op3_minimax_shards": op3_minimax_shards,
        "op4_source_mix": op4_source_mix,
        "op5_secret_spans": op5_secret_spans,
        "op6_near_dedup": op6_near_dedup,
        "op7_quality": op7_quality,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_url_filter": op11_url_filter,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_token_alignment": op13_token_alignment,
    }
