"""Explicit schemas and the order of the feature columns."""

from __future__ import annotations

SCHEMA_VERSION = "ohlcv-features-v1"

CANDLES = "product_id STRING, granularity_sec INT, ts_start TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, ingest_seq BIGINT"
PRODUCTS = "id STRING, base_currency STRING, quote_currency STRING, status STRING"
FEATURES = (
    "price vwap ret_5m ret_30m bench_ret_30m ema_diff_pct adx atr_pct rv rvol_tod obv_slope vwap_loc donch_dist time_remaining_frac "
    "log_minutes_remaining tod_frac log1p_med_dvol med_range_pct cur_range_pct med_wick_atr cur_wick_atr i_ret30_rvol i_ret30_vwaploc "
    "i_ema_adx i_ret30_timefrac"
).split()
SCORES = (
    "product display_symbol price vwap risk risk_reasons prob_1 prob_2 prob_1_source prob_2_source quote category reasons "
    "last_candle_time included skip_reason"
).split()
