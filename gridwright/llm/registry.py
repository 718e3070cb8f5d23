"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridwright.llm import byte_spans, exact_dedup, license_scan, quality_rules, word_spans
from gridwright.llm.alignment import op11_alignment
from gridwright.llm.byte_spans import op9_byte_spans
from gridwright.llm.exact_dedup import op6_exact_dedup
from gridwright.llm.license_scan import op13_license_scan
from gridwright.llm.mixing import op10_mixing
from gridwright.llm.quality_classifier import op1_quality_classifier
from gridwright.llm.quality_rules import op7_quality_rules
from gridwright.llm.resampling import op12_resampling
from gridwright.llm.sentencepieces import op3_sentencepieces
from gridwright.llm.sharding import op4_sharding
from gridwright.llm.simhash import op5_simhash
from gridwright.llm.token_output import op8_token_output
from gridwright.llm.word_spans import op2_word_spans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_word_spans": op2_word_spans,
        "op3_sentencepieces": op3_sentencepieces,
        "op4_sharding": op4_sharding,
        "op5_simhash": op5_simhash,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_output": op8_token_output,
        "op9_byte_spans": op9_byte_spans,
        "op10_mixing": op10_mixing,
        "op11_alignment": op11_alignment,
        "op12_resampling": op12_resampling,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_word_spans": word_spans.ORACLE_SQL,
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
        "op7_quality_rules": quality_rules.ORACLE_SQL,
        "op9_byte_spans": byte_spans.ORACLE_SQL,
        "op13_license_scan": license_scan.ORACLE_SQL,
    }
