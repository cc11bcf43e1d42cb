"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, langid, license, media, mixing, ngram_join, oracles, quality_rules, resample, rule_ensemble, simhash, suffix_dedup, turn_repair, url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": url_rules.op1_url_filters,
        "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
        "op3_quality_classifier": rule_ensemble.op3_quality_classifier,
        "op4_media_columns": media.op4_media_columns,
        "op5_suffix_array_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_bpe": bpe.op8_bpe_round_trip,
        "op9_language_id": langid.op9_language_id,
        "op10_license_scan": license.op10_license_scan,
        "op11_ngram_join": ngram_join.op11_ngram_join,
        "op12_importance_resampling": resample.op12_importance_resampling,
        "op13_conversation_repair": turn_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.oracle(), "op10_license_scan": license.oracle(), "op11_ngram_join": oracles.op11(), "op12_importance_resampling": oracles.op12(), "op13_conversation_repair": oracles.op13()}
