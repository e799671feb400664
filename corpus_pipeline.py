"""A corpus pipeline of five stages over ``documents``; each stage works on what its predecessor kept.

1. language ID drops documents whose language is not recognised;
2. MinHash near-dedup keeps one document of each group of near copies;
3. benchmark decontamination drops documents that hold a benchmark passage;
4. the secret scan drops documents that hold a secret;
5. retrieval packing puts the rest into windows.

All but the last return the columns of ``documents``, extra ones and clashing ones too.

Nulls: a row without text has no language and goes in stage 1, as do empty texts and texts without letters; a row without doc_id passes
stages 2 to 4 (4 drops it if it holds a secret) and fills no window.  Very long texts are read whole in every stage.  Repeated rows of one doc_id and text
share their fate and fill one window; rows of one doc_id with different texts are near copies or contaminated together, by their doc_id.  Ties: of equal
copies the smallest doc_id stays.  An empty table, or one without labelled languages, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, langid, minhash, packing, secrets
from lexloom.storage import bound_batches, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.drop_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.retrieval_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("secret_scan", drop_secrets),
    ("retrieval_packing", pack),
]

#: Language ID, one-permutation hashing and greedy packing can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
