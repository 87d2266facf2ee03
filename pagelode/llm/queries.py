"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import blob_ledger, bpe_chunks, decontaminate, license_rules, line_runs, ngram_join, pii_boost, rule_ledger, tag_paths, token_shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda f: lambda spark, sf_dir: f(_table(spark, sf_dir, "documents"))
    return {
        "op1_line_dedup": docs(line_runs.op1_line_dedup),
        "op2_license_scan": docs(license_rules.op2_license_scan),
        "op3_decontamination": lambda spark, sf_dir: decontaminate.op3_decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
        "op4_personal_data": docs(pii_boost.op4_personal_data),
        "op5_main_text": lambda spark, sf_dir: tag_paths.op5_main_text(_table(spark, sf_dir, "pages")),
        "op6_token_ids": docs(token_shards.op6_token_ids),
        "op7_ngram_jaccard": docs(ngram_join.op7_ngram_jaccard),
        "op8_secret_scan": docs(blob_ledger.op8_secret_scan),
        "op9_bpe_roundtrip": docs(bpe_chunks.op9_bpe_roundtrip),
        "op10_quality_rules": docs(rule_ledger.op10_quality_rules),
    }


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force in ``tests/llm``."""
    return {"op1_line_dedup": line_runs.OP1_SQL, "op3_decontamination": decontaminate.OP3_SQL, "op10_quality_rules": rule_ledger.OP10_SQL}
