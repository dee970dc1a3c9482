"""Registered queries against DuckDB. A cross-section by default; every query with
RACEFLOW_ALL=1 (about ten minutes)."""

import os

import pytest

import raceflow.catalog  # noqa: F401
from compare import compare, connect
from raceflow import skew
from raceflow.registry import ENTRIES

QUICK = ["race_feature_flagship", "prior_cumulative_sums", "recent_form_summary", "point_in_time_history",
         "race_z_score", "rank_within_race", "keep_last_per_key", "text_margin_to_seconds", "distance_bands",
         "tolerant_select", "work_list", "key_coverage", "upsert_append", "entity_statistics", "nicks", "interaction_statistics", "statistics_before_each_row",
         "spearman_per_race", "threshold_sweep", "equity_curve", "duplicate_profile", "log_outcomes",
         "probability_audit", "stake_allocation", "pedigree_wide_form", "write_partitioned", "read_latest_per_partition", "outcome_documents", "latest_odds_snapshot", "incremental_upsert",
         "data_version_record", "file_size_summary", "regional_races", "validation_limits", "recommendations", "page_charset",
         "expanding_date_folds", "group_safe_holdout", "top_orders_per_race", "exclusive_kelly_stakes", "ancestors_of_any_depth", "profile_from_monthly_sketches", "log_throughput", "as_of_profile", "as_of_latest_price", "one_hot_rows", "changed_data_blocks",
         "listwise_rank_scorer", "expanding_row_folds", "compatibility_dates"]
NAMES = list(ENTRIES) if os.environ.get("RACEFLOW_ALL") else QUICK


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, sf, name):
    problem, _ = compare(spark, duck, ENTRIES[name], sf)
    assert problem == ""


HOT = ["race_z_score", "race_deviation_score", "rank_within_race", "gap_and_ratio_to_race_mean", "relevance_label",
       "spearman_per_race", "fractional_top_roi", "top_k_overlap", "as_of_profile", "as_of_latest_price", "exclusive_kelly_stakes", "listwise_rank_scorer"]


@pytest.mark.parametrize("name", HOT)
def test_matches_oracle_with_hot_races(spark, duck, sf, monkeypatch, name):
    """Races of seven lines are treated as hot keys, and no statistics table is broadcast."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.raceflow.hotRows", "7")
    try:
        problem, _ = compare(spark, duck, ENTRIES[name], sf)
    finally:
        spark.conf.unset("spark.raceflow.hotRows")
    assert problem == ""


def test_every_query_names_what_it_covers():
    assert all(e.covers for e in ENTRIES.values())
    assert not any(n.startswith("op") and n[2:3].isdigit() for n in ENTRIES)
