"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import alignment, ann, bpe, brown, langid, line_dedup, minhash, mixing, ngram_join, periods, quality, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_language_id": langid.query,
        "op3_bpe_encoding": bpe.query,
        "op4_ngram_jaccard_join": ngram_join.query,
        "op5_nearest_neighbours": ann.query,
        "op6_quality_rules": quality.query,
        "op7_mixing": mixing.query,
        "op8_brown_lm": brown.query,
        "op9_url_filters": url_filter.query,
        "op10_line_dedup": line_dedup.query,
        "op11_minhash": minhash.query,
        "op12_periodic_runs": periods.query,
        "op13_token_alignment": alignment.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard_join": ngram_join.ORACLE,
        "op6_quality_rules": quality.ORACLE,
        "op9_url_filters": url_filter.ORACLE,
        "op11_minhash": minhash.ORACLE,
    }
