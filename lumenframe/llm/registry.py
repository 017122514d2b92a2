"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontamination, html_extraction, jaccard_join, license_scan, lm_scoring, quality_classifier, quality_rules, substring_dedup, toxicity
from .common import table


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


def _with_labels(query: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": _over("documents", lm_scoring.query),
    "op2_html_extraction": _over("pages", html_extraction.query),
    "op3_license_scan": _over("documents", license_scan.query),
    "op4_byte_bpe": _over("documents", byte_bpe.query),
    "op5_toxicity": _with_labels(toxicity.query),
    "op6_quality_classifier": _with_labels(quality_classifier.query),
    "op7_jaccard_join": _over("documents", jaccard_join.query),
    "op8_substring_dedup": _over("documents", substring_dedup.query),
    "op9_decontamination": lambda spark, sf_dir: decontamination.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op10_quality_rules": _over("documents", quality_rules.query),
}

ORACLE_SQL: dict[str, str] = {
    "op9_decontamination": decontamination.ORACLE_SQL,
}
