"""Queries of the training-data operators: whole tables, production parameters, the result columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_language, op2_repetition, op3_decontaminate, op4_toxicity, op5_url_filter, op6_html, op7_brown, op8_mix, op9_jaccard, op10_tokens, op11_chosen_path, op12_whitening, op13_alignment
from .common import is_remainder, table

#: The URL rules that the query applies, as (verdict, host, path).
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
TOKENIZER = "word_bpe_49k.json"
#: The tokenizers that are aligned.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_remainder("doc_id", 3, 1)
    model = op1_language.fit_dictionaries(docs.where(~held_out))
    return op1_language.identify(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_repetition.rate(table(spark, sf_dir, "documents")).drop("spans", "longest_repeat")


def op3_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3_decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), is_remainder("doc_id", 3, 1)
    model = op4_toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return op4_toxicity.score(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op6_html.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op7_brown.score(table(spark, sf_dir, "documents"), is_remainder("doc_id", 7, 2))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op10_tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op11_chosen_path.link(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found, _ = op13_alignment.align_documents(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))
    return found.select("doc_id", *op13_alignment.MEASURES, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_repetition_rules, op3_benchmark_overlap, op4_toxicity_scores, op5_url_verdicts, op6_main_text, op7_class_scores, op8_source_mix, op9_jaccard_components, op10_token_counts, op11_near_duplicates, op12_embedding_whitening, op13_tokenizer_alignment)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
