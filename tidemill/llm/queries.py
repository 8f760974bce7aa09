"""One thin query per operator over a whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, jaccard_join, line_dedup, lm_scoring, packing, quality_knn, quality_rules, sharding, suffix_dedup
from .common import table

_OPERATORS = {
    "op1_quality_rules": quality_rules,
    "op2_jaccard_join": jaccard_join,
    "op3_exact_dedup": exact_dedup,
    "op4_bpe": bpe,
    "op5_sharding": sharding,
    "op6_lm_scoring": lm_scoring,
    "op7_suffix_dedup": suffix_dedup,
    "op8_packing": packing,
    "op9_line_dedup": line_dedup,
}


def _over_documents(module) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: module.query(table(spark, sf_dir, "documents"))


def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _over_documents(m) for name, m in _OPERATORS.items()} | {"op10_quality_knn": _classify}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.oracle(),
        "op2_jaccard_join": jaccard_join.ORACLE,
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op5_sharding": sharding.oracle(),
        "op7_suffix_dedup": suffix_dedup.ORACLE,
    }
