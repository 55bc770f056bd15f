"""The registered queries over the corpus tables, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .bpe_codec import digests, encode
from .decontaminate import contamination
from .jaccard_join import jaccard_components
from .labelled import held_out
from .licenses import scan_licenses
from .lm_scoring import fit_network, score_documents
from .mixing import mix
from .pii import replace_entities
from .prefix_trie import prefix_trie, rebuilt
from .quality_classifier import fit_quality, score_quality
from .quality_rules import BASE_RULES, quality_verdicts
from .rows import table
from .token_counts import prefix_token_counts
from .toxicity import fit_toxicity, score_toxicity
from .vector_codes import books_digest, vector_codes, with_group_error


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = prefix_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                  budgets=(512,), keep_prefixes=False)
    return counted.select("doc_id", "n_bytes", "n_tokens",
                          (F.col("n_tokens") > 512).alias("over_limit"), "chars_within_512")


def op1_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, *fit_network(docs)).drop("text")


#: Whoever knows the key can tell whether a guessed entity lies behind a surrogate.
SURROGATE_KEY = "change-me-per-release"


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, SURROGATE_KEY, count="n_entities")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_verdicts(docs, report=figures, always=BASE_RULES)
    return judged.select("doc_id", *figures, "base_failed", "kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~out)
    return (score_quality(docs, model)
            .select("doc_id", out.alias("held_out"), "score", "predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    weights = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~out)
    return (score_toxicity(docs, weights)
            .select("doc_id", out.alias("held_out"), "score", "predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text")


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return encode(docs, vocabulary, repeatable=True, after=digests(vocabulary))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return (with_group_error(coded).withColumn("codebooks_sha256", F.lit(books_digest(books)))
            .select("vec_id", "code", "error", "label_error", "codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run
    return run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_masked_pseudo_likelihood": op1_masked_pseudo_likelihood,
    "op10_license_scan": op10_license_scan,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
    "op2_surrogates": op2_surrogates,
    "op3_mix_sources": op3_mix_sources,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op6_prefix_token_counts": op6_prefix_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": oracle.MIX_SOURCES,
    "op4_benchmark_decontamination": oracle.DECONTAMINATION,
    "op9_jaccard_join": oracle.JACCARD_JOIN,
    "op5_quality_rules": oracle.QUALITY_RULES,
    "op12_vector_codes": oracle.VECTOR_CODES,
    "op13_prefix_trie": oracle.PREFIX_TRIE,
}
