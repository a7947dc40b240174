"""Registered queries against their DuckDB twins on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import compare, duck  # noqa: E402

from riskfold.catalog import REGISTRY  # noqa: E402

SF = "/root/testdata/sf0.001"
FAST = ["scan_normalise", "dedupe_rows", "clean_target", "stratified_split", "stratified_folds", "folds_unshuffled",
        "fold_report", "inner_folds", "class_weights", "impute_mode", "encode_onehot", "preprocess_apply",
        "roc_auc", "pr_auc", "fold_metrics", "model_comparison", "pairwise_stability", "stability_summary",
        "describe_numeric", "box_stats", "entity_aggregates", "leakage_checks", "csv_scan", "dedupe_documents",
        "fold_kendall_matrix", "value_counts_all", "rate_by_category_ordered", "metric_guards_planted",
        "validate_folds_planted", "stability_extremes", "outlier_counts_train", "entity_features"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_registered():
    from __spark_entry__ import oracle_sql, queries  # noqa: F401
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 70


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    status, n, *_rest, msg = compare(spark, con, name, REGISTRY[name], SF)
    assert status == "PASS", msg
