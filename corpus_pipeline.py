"""The corpus pipeline: quality rules, line deduplication, near-duplicate removal, decontamination, BPE.

Defined cases, of every stage: a null or empty text has no words, so the quality rules reject it; each stage alone takes
it as the operator's own docstring says (no line is dropped, it is alone in its class, no window occurs in it, it has no
ids). Repeated rows are judged alike and count one by one as documents of a line; of rows that repeat id and text one
stays after near-duplicate removal. Of a class the smallest id stays, a null id only if there is no other. Columns beyond
those of ``documents`` pass through all stages but the last; those named like a stage's own are kept as they came. Very
long texts are processed whole. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import bpe_chunks, decontaminate, line_runs, ngram_join, rule_ledger
from pagelode.sources.work import saved, tidied


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go."""
    return rule_ledger.keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go from every text; ``n_chars`` follows the text."""
    done = line_runs.dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left."""
    return bpe_chunks.digest_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: Near duplicates are classes of a transitive relation and BPE has no SQL form.
ORACLE_SQL = None


@tidied
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
