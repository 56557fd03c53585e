"""Registered queries of the numbered operators, over the whole tables; ``SQL`` is
the DuckDB SQL of those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphdelta.llm.common import documents
from graphdelta.llm.sql import SQL


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.token_counts import token_counts
    return token_counts(documents(spark, sf_dir), limit=4096)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.ngram_join import near_duplicates
    return near_duplicates(documents(spark, sf_dir), words=5, percent=80).select(
        "doc_id", "n_shingles", "component_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.decontamination import contaminated, digest
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return digest(contaminated(documents(spark, sf_dir), benchmark, words=5, percent=80))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.secrets import digest, fit_secret_model, scan_secrets
    docs = documents(spark, sf_dir)
    return digest(scan_secrets(docs, fit_secret_model(docs)))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.fingerprints import fingerprint_edits
    return fingerprint_edits(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.packing import pack
    return pack(documents(spark, sf_dir), size=1024)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.suffix_dedup import digest, repeated_passages
    return digest(repeated_passages(documents(spark, sf_dir), least=50))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.substring_dedup import digest, remove_repeats
    return digest(remove_repeats(documents(spark, sf_dir), window=35))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.line_dedup import digest, repeated_lines
    return digest(repeated_lines(documents(spark, sf_dir), words=5, percent=80))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.toxicity import fit_toxicity, score_toxicity
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.fill_in_middle import digest, fill_in_middle
    return digest(fill_in_middle(documents(spark, sf_dir)))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.topk_search import top_k
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors["vec_id"] % 20 == 0, k=20, scale=64.0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphdelta.llm.divergence import source_divergence
    return source_divergence(documents(spark, sf_dir), least_docs=10, top_terms=10)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_secret_scans, op4_token_counts,
    op5_document_fingerprints, op6_packing, op7_suffix_array_dedup, op8_substring_dedup,
    op9_line_dedup, op10_toxicity, op11_fill_in_middle, op12_topk_search, op13_source_divergence)}

__all__ = ["QUERIES", "SQL"]
