"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import automaton, decontaminate, embeddings, langid, minhash, packing, pii, secrets, suffix_array, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
        "op2_language_id": langid.op2_language_id,
        "op3_retrieval_packing": packing.op3_retrieval_packing,
        "op4_substring_dedup": automaton.op4_substring_dedup,
        "op5_suffix_array_dedup": suffix_array.op5_suffix_array_dedup,
        "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
        "op7_html_extraction": wrappers.op7_html_extraction,
        "op8_embedding_near_dedup": embeddings.op8_embedding_near_dedup,
        "op9_pii_surrogates": pii.op9_pii_surrogates,
        "op10_secret_scan": secrets.op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": automaton.OP4_SQL,
        "op5_suffix_array_dedup": suffix_array.OP5_SQL,
        "op8_embedding_near_dedup": embeddings.OP8_SQL,
        "op10_secret_scan": secrets.OP10_SQL,
    }
