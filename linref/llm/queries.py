"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linref.llm import contamination, fingerprint, jaccard, language_model, main_text, manifest, negatives, packing, personal_data, sharding, sql, substrings, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> tuple[str, str, str]:
    import public_tokenizers

    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_decontamination(spark, d):
    return contamination.leak_report(_read(spark, d, "documents"), _read(spark, d, "benchmark"))


def op2_substring_dedup(spark, d):
    return substrings.dedup_digest(_read(spark, d, "documents"))


def op3_packing(spark, d):
    return packing.pack(_read(spark, d, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_toxicity(spark, d):
    return toxicity.toxicity(_read(spark, d, "documents"), _read(spark, d, "labels"))


def op5_token_counts(spark, d):
    return token_counts.token_counts(_read(spark, d, "documents"), *byte_bpe())


def op6_fingerprints(spark, d):
    return fingerprint.fingerprints(_read(spark, d, "documents"))


def op7_jaccard_join(spark, d):
    return jaccard.component_digest(_read(spark, d, "documents"))


def op8_lm_scoring(spark, d):
    return language_model.scores(_read(spark, d, "documents"))


def op9_html_extraction(spark, d):
    return main_text.main_text(_read(spark, d, "pages"))


def op10_sharding(spark, d):
    return sharding.shard(_read(spark, d, "documents"))


def op11_hard_negatives(spark, d):
    """Where vec_id is a multiple of 7 the label is the next one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_read(spark, d, "embeddings").withColumn("label", label))


def op12_merkle_manifest(spark, d):
    return manifest.manifest(_read(spark, d, "documents"), manifest.lowered_every_third())


def op13_personal_data(spark, d):
    return personal_data.digest(_read(spark, d, "documents"))


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_substring_dedup, op3_packing, op4_toxicity, op5_token_counts, op6_fingerprints, op7_jaccard_join,
                                   op8_lm_scoring, op9_html_extraction, op10_sharding, op11_hard_negatives, op12_merkle_manifest, op13_personal_data, pipeline)}
ORACLES: dict[str, str] = dict(sql.ORACLES)
