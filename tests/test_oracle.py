"""Queries against their SQL on the smallest tables; the driver does the same for all at a larger size."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = ["src_01_price_scan", "src_08_filing_extract", "src_17_read_through", "src_19_merge_fresh", "dml_01_insert_ignore", "dml_02_upsert", "flt_06_cooldown", "flt_16_left_out_screen", "srt_01_unique_lag_top", "join_08_round_trips", "join_12_events_in_hold", "join_13_hold_classes", "agg_09_run_metrics", "agg_12_pair_pnl", "agg_26_auc", "win_09_rank_bins", "win_12_equity", "scl_01_sic_sector", "scl_14_item_groups", "udx_22_fifo_match", "src_16_csv_cache", "src_20_batch_outcome", "src_22_warm_cache", "src_28_prewarm", "dml_08_snapshot_restore", "dml_09_append_facts", "dml_10_update_else_insert", "dml_11_schema_evolution", "dml_11_constraints", "dml_12_retention", "dml_13_order_sink", "flt_02_without_failed", "flt_03_failed_in_window", "flt_08_mirror_conflict", "flt_17_best_run", "join_15_event_days", "agg_03_corr_matrix", "agg_06_spearman", "agg_16_pool_corr", "agg_19_tercile_outcomes", "agg_21_profile_medians", "agg_25_trimmed_means", "agg_28_bootstrap_rate_gap", "agg_29_date_bootstrap", "agg_42_rankers", "agg_45_drop_one_date", "agg_46_book_policy", "agg_53_sampled_coverage", "smp_01_sample_per_fold", "win_10_value_bins", "udx_06_cluster_ranks", "udx_08_ma_grid", "udx_09_z_simulation", "udx_10_z_grid", "udx_11_holdout", "udx_12_replay", "udx_14_exit_replay", "udx_16_config_select", "udx_18_stops", "udx_23_unit_signal", "udx_24_holdout_gap", "udx_25_null_baseline", "udx_31_study", "udx_32_regime_features", "udx_33_battery_report", "udx_34_calendar_shift_null", "scl_22_corr_distance", "ctrl_01_daily_scoring", "ctrl_01_penny", "ctrl_04_metadata_load", "ctrl_05_run_attribution", "ctrl_05_run_by_token", "loop_01_study_base", "loop_02_phase_gate", "src_04_bar_source", "src_15_fold_cache", "src_17_read_through_stored", "src_17_read_through_answer", "dml_01_insert_ignore_stream", "dml_02_upsert_stream", "dml_05_allocated_ids", "flt_03_failed_for_requests", "flt_06_cooldown_stream", "join_19_overlapping_holds", "win_17_hysteresis_stream", "agg_27_fisher_exact", "agg_49_regression_p", "agg_50_component_p", "agg_51_decile_error", "udx_01_unit_root_tau", "udx_02_unit_root_tau", "udx_27_report_panel"]


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DIR}/{f}')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = [dict(zip(cols, r, strict=True)) for r in cur.fetchall()]
    df = entry.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(cols)
    key = lambda r: tuple(str(cell(r[c])) for c in sorted(cols))
    assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, want))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["lead", "lag", "score", "rank"]
