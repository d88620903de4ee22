"""Queries of the training-data operators, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ngram_join, packing, piece_lattice, quality_model, quality_rules, secrets, token_counts, toxicity, url_rules, vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_quality": quality_model.query,
        "op3_ngram_join": ngram_join.query,
        "op4_quality_rules": quality_rules.query,
        "op5_url_rules": url_rules.query,
        "op6_vector_search": vector_search.query,
        "op7_packing": packing.query,
        "op8_piece_lattice": piece_lattice.query,
        "op9_token_counts": token_counts.query,
        "op10_secrets": secrets.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_rules": url_rules.ORACLE}
