"""Every query with an oracle agrees with DuckDB on the small tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tidemark import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.01"
#: One or two of each group; the driver compares all of them.
NAMES = [
    "a01_bar_csv_scan", "a06_event_json_scan", "a07_macro_panel", "a09_merge_runs", "a09_committed_runs", "a04_bucketed_layer", "b02_outlier_filter", "b06_fraction_split", "c02_intraday_returns",
    "d06_daily_measures", "d06_appended_days", "e12_appended_days", "e12_appended_wide_days", "k01_pooled_deciles", "d10_realised_kernel", "e12_feature_table", "f03_asof_join", "f03_asof_one_reference", "f03_asof_by_user", "g01_least_squares", "g02_har", "g21_rolling_window", "h02_inverse_mse_weights",
    "i07_cross_section", "j01_newey_west_lrv", "j02_diebold_mariano", "j07_holm", "j13_ratio_interval", "j21_efficiency_table", "k01_decile_losses", "l05_conditional_coverage", "m02_variable_importance",
    "a05_markdown_catalogue", "a09_merge_with_validation", "b04_wide_model_columns", "g04_lev_har", "g06_harq", "g11_elastic_net_one_regressor", "g21_rolling_refit_monthly", "g21_rolling_har_family", "g21_rolling_har_embargo", "g21_rolling_har_x", "g23_linear_panel", "g24_date_split_run", "g25_training_sizes", "g29_coefficients",
    "g27_kernel_robustness", "h04_two_model_combinations", "j03_small_sample_p_values", "j14_path_intervals", "j15_model_confidence_set", "l02_expanding_quantile_monthly", "m04_autocorrelation", "m04_forecast_memory", "m05_error_correlation", "j04_pairwise_matrix", "j11_loss_interval", "m06_shapley_linear_rule",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(None if pd.isna(v) else bool(v) if isinstance(v, bool) else v for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    found, expected = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found) == plain(expected) and len(found)


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry_imports_alone():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
