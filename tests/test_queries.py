"""Registered queries against their SQL, and the driver contract."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from verify import compare, connect  # noqa: E402

NO_SQL = {
    "h11_em_fit", "a12_signal_effect", "a13_half_split_auc", "c4_audit_finds_same_day_leak",
}
CHECKED = [
    "b1_vwap_bars", "b1_vwap_bars_ties", "b1_vwap_bars_by_symbol", "q3_coverage", "l6_day_metrics", "d4_all_rules", "e2_trades",
    "k7_performance", "n2_shifted_zscore", "g2_random_timing", "h5_decayed_sums", "s1_parse_agg_trades", "a15_autocorrelation",
    "h6_intensities", "h11_rejects", "h16_full_review", "h19_provenance", "g3_encoded_signals", "k4_theta_days_left", "q6_runs_go_on", "s7_bars_go_on",
    "s9_theta_store", "c2_perturb_world_resample", "a8_model_gap_signed_rank",
]


def test_every_query_has_sql_or_a_reason():
    from sparktick.queries import QUERIES, SQL

    assert set(QUERIES) - set(SQL) == NO_SQL and set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].n_days == 30


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf, name):
    state, _ = compare(spark, connect(sf), entry.queries()[name], entry.oracle_sql()[name], sf)
    assert state.startswith("ok"), state
