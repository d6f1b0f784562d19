"""All queries of the library outside the llm subpackage.

Sums of doubles depend on their order in the last places, so both sides of a comparison round the columns
named in DOUBLES to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.plans import bookkeeping, compaction, corpus, evaluation, flows, kernels, planner, rasters

FLAGSHIP = "a7_auc"
DIGITS = 6
DOUBLES = {
    "a7_auc": ("auc",),
    "a7_auc_by_part": ("auc",),
    "w3_roc_points": ("tpr", "fpr"),
    "a9_calibration": ("auc",),
    "a11_error_rates": (
        "false_positive_rate", "true_positive_rate", "true_positive_rate_at_validation_1pct_fpr", "actual_false_positive_rate_at_that_threshold", "equal_prior_error",
    ),
    "a13_bootstrap": ("auc", "low", "high"),
    "a12_robust": ("orientation_robust_auc", "orientation_robust_auc_upper_95"),
    "a16_max_upper": ("max_upper",),
    "a14_paired_difference": ("delta", "low", "high", "robust_low", "robust_high"),
    "a2_success_means": ("mean_changed_pixels", "mean_psnr", "mean_balance_objective_before", "mean_balance_objective_after"),
    "a3_grouped_median": ("median_seconds",),
    "a5_paired_saving": ("median_saving", "min_saving", "max_saving"),
    "a6_stage_means": ("mean",),
    "w5_stage_seconds": ("seconds",),
    "q_p5_payload_summary": ("net_bpp", "stored_net_bpp", "gross_bpp", "capacity_used_percent"),
    "a17_pair_difference": ("difference",),
    "a18_adjacent_bins": ("score",),
    "a19_rs_score": ("score",),
    "a23_rs_fractions": ("rises", "falls", "stays"),
    "a22_local_moments": ("mean", "variance"),
    "a24_objective": ("distance",),
    "k2_correlation": ("total",),
    "e_compare": ("delta", "low", "high", "robust_low", "robust_high", "a", "b"),
    "a28_vector_moments": ("mean", "deviation"),
    "a29_class_products": ("mean_product",),
}

_MODULES = (compaction, evaluation, corpus, bookkeeping, planner, rasters, kernels, flows)
Query = Callable[[SparkSession, str], DataFrame]


def _rounded(query: Query, columns: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # adding zero makes a negative zero positive
        return query(spark, sf_dir).withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in columns})

    return run


def _rounded_sql(sql: str, columns: tuple[str, ...]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, {DIGITS}) + 0::DOUBLE AS {c}' for c in columns)}) FROM ({sql})"


QUERIES: dict[str, Query] = {
    name: _rounded(query, DOUBLES[name]) if name in DOUBLES else query for m in _MODULES for name, query in m.QUERIES.items()
}
ORACLE: dict[str, str] = {name: _rounded_sql(sql, DOUBLES[name]) if name in DOUBLES else sql for m in _MODULES for name, sql in m.ORACLE.items()}
