"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftlink.llm import fingerprints, line_dedup, mixing, near_dup, packing, quality, rollups, toxicity, url_rules, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_near_duplicates": near_dup.op3_near_duplicates,
        "op4_warc_derivatives": warc.op4_warc_derivatives,
        "op5_url_rules": url_rules.op5_url_rules,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_mixing": mixing.op7_mixing,
        "op8_packing": packing.op8_packing,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_token_rollups": rollups.op10_token_rollups,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op3_near_duplicates": near_dup.OP3_SQL,
        "op5_url_rules": url_rules.OP5_SQL,
        "op9_quality_rules": quality.OP9_SQL,
    }
