"""Registered queries beside their check SQL. PROBITY_ALL=1 runs every one (several minutes)."""

import os

import pytest

from compare import database, differences
from probity.plans.catalog import load

CHECKED = sorted(load().sql)
SOME = {
    "overall_analysis", "rule_class", "softmax_probabilities", "zero_shot_mapping", "days_since_last_review", "rolling_stars",
    "reviewer_profile", "content_features", "category_summary", "threshold_decision", "per_class_scores", "binary_metrics",
    "ranking_metrics_with_ties", "class_average_precision", "stage_complement", "batch_summary", "daily_trend", "result_page",
    "labelled_rows", "label_prompts", "metadata_fill", "budgeted_routing", "quantile_mapping", "sliced_metrics", "stream_totals",
}


@pytest.fixture(scope="module")
def db(folder):
    return database(folder)


@pytest.mark.parametrize("name", CHECKED if os.environ.get("PROBITY_ALL") else sorted(SOME))
def test_equals_sql(name, spark, catalog, db, folder):
    assert differences(catalog.queries[name](spark, folder), db, catalog.sql[name]) == []


def test_names_and_cover(catalog):
    assert SOME <= set(CHECKED)
    assert set(catalog.sql) <= set(catalog.queries)
    assert all(catalog.covers.values())


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
