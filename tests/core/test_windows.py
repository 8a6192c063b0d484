from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators.chunks import with_chunks
from tidemark.operators.windows import ewm
from tidemark.plans.features import indicators, last_bars, volume_profile
from tidemark.schemas import FEATURES
from tidemark.sources.candles import completed

START = dt.datetime(2024, 1, 1)


def frame(spark, products: dict[str, pd.DataFrame]):
    rows = []
    for p, df in products.items():
        for i, r in enumerate(df.itertuples(index=False)):
            rows.append((p, 300, pd.Timestamp(r.ts_start).to_pydatetime(), float(r.open), float(r.high), float(r.low), float(r.close), float(r.volume), i))
    return spark.createDataFrame(rows, "product_id string, granularity_sec int, ts_start timestamp_ntz, open double, high double, low double, close double, volume double, ingest_seq long")


def walk(n: int, seed: int = 0, gaps: bool = False) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    open_ = np.r_[close[:1], close[:-1]]
    high, low = np.maximum(open_, close) * (1 + rng.random(n) * 0.002), np.minimum(open_, close) * (1 - rng.random(n) * 0.002)
    steps = np.cumsum(rng.integers(1, 4, n)) if gaps else np.arange(n)
    return pd.DataFrame({"ts_start": [START + dt.timedelta(minutes=5 * int(s)) for s in steps], "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 50, n)})


def by_pandas(df: pd.DataFrame) -> pd.DataFrame:
    """The indicators written again, from their definitions."""
    c, h, lo, v = df.close, df.high, df.low, df.volume.astype(float)
    e = 1e-12
    mean = lambda s, a: s.ewm(alpha=a, adjust=False).mean()
    tr = np.fmax(np.fmax((h - lo).abs(), (h - c.shift()).abs()), (lo - c.shift()).abs())
    up, down = h.diff(), -lo.diff()
    pdm, mdm = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    atr = mean(tr, 1 / 14)
    p, m = 100 * mean(pdm, 1 / 14) / (atr + e), 100 * mean(mdm, 1 / 14) / (atr + e)
    vwap = ((c * v).rolling(24, min_periods=6).sum() / (v.rolling(24, min_periods=6).sum() + e)).bfill().fillna(c)
    obv = (np.sign(c.diff().fillna(0)) * v).cumsum()
    slope = obv.rolling(24).apply(lambda y: np.polyfit(np.arange(24), y, 1)[0], raw=True).fillna(0)
    med = lambda s: s.rolling(12, min_periods=3).median().fillna(0)
    wick = (h - np.maximum(df.open, c) + np.minimum(df.open, c) - lo) / (atr + e)
    base = v.shift().rolling(12, min_periods=3).median()
    return pd.DataFrame(
        {
            "ret_30m": c.pct_change(6).fillna(0), "ema_diff_pct": (mean(c, 2 / 13) - mean(c, 2 / 27)) / (c + e), "adx": mean(100 * (p - m).abs() / (p + m + e), 1 / 14), "atr_pct": atr / (c + e),
            "rv": np.log((c + e) / (c.shift() + e)).fillna(0).rolling(24, min_periods=6).std().fillna(0), "vwap": vwap, "donch_dist": ((h.rolling(72, min_periods=6).max() - c) / (atr + e)).fillna(0),
            "obv_slope": slope, "log1p_med_dvol": np.log1p(med(c * v)), "med_range_pct": med((h - lo) / (c + e)), "med_wick_atr": med(wick), "rvol_tod": (v / (base + e)).fillna(1.0),
        }
    )


@pytest.mark.parametrize("chunk", [8192, 700])
def test_indicators_match_pandas_also_across_chunks(spark, chunk):
    data = {"a": walk(1500, 1), "b": walk(1500, 2, gaps=True), "c": walk(7, 3)}
    got = indicators(frame(spark, data), Settings(), F.lit("2030-01-01").cast("timestamp_ntz"), chunk=chunk).toPandas()
    for p, df in data.items():
        own = got[got.product_id == p].sort_values("ts_end").reset_index(drop=True)
        assert len(own) == len(df) and own.i.tolist() == list(range(len(df)))
        want = by_pandas(df)
        for c in want:
            np.testing.assert_allclose(own[c], want[c], rtol=1e-8, atol=1e-8, err_msg=f"{p} {c}")


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_short_series(spark, n):
    got = indicators(frame(spark, {"a": walk(n)}), Settings(), F.lit("2030-01-01").cast("timestamp_ntz")).toPandas()
    assert len(got) == n and got[FEATURES].notna().all().all()
    np.testing.assert_allclose(got.sort_values("ts_end")["vwap"], by_pandas(walk(n))["vwap"])
    assert (got.rv == 0).all() if n < 6 else True


def test_flat_price_and_zero_volume(spark):
    df = walk(40)
    df[["open", "high", "low", "close"]] = 5.0
    df["volume"] = 0
    got = indicators(frame(spark, {"a": df}), Settings(), F.lit("2030-01-01").cast("timestamp_ntz")).toPandas()
    assert np.isfinite(got[FEATURES].to_numpy()).all() and (got.adx == 0).all() and (got.atr_pct == 0).all()


def test_constant_ewm_is_constant(spark):
    df = walk(300)
    df["close"] = 3.0
    rows = with_chunks(completed(frame(spark, {"a": df}), F.lit("2030-01-01").cast("timestamp_ntz")))
    got = [r["y"] for r in ewm(rows, {"close": "y"}, 1 / 14).where("core").select("y").collect()]
    np.testing.assert_allclose(got, 3.0, rtol=1e-12)


def test_duplicates_incomplete_bars_and_empty(spark):
    df = walk(30)
    twice = pd.concat([df, df.assign(close=df.close * 2, high=df.high * 2)])
    as_of = F.lit((df.ts_start.iloc[-1] + dt.timedelta(minutes=4)).to_pydatetime()).cast("timestamp_ntz")
    got = indicators(frame(spark, {"a": twice}), Settings(), as_of)
    pdf = got.toPandas().sort_values("ts_end")
    assert len(pdf) == 29
    np.testing.assert_allclose(pdf["price"], 2 * df.close[:29])
    assert got.limit(0).count() == 0 and indicators(frame(spark, {"a": df}).limit(0), Settings(), as_of).count() == 0
    assert last_bars(got).first()["n_bars"] == 29


def test_profile_needs_days_and_midnight_is_next_day(spark):
    bars = completed(frame(spark, {"few": walk(288 * 7), "enough": walk(288 * 9 + 5)}), F.lit("2030-01-01").cast("timestamp_ntz"))
    got = volume_profile(bars, Settings(), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))
    notes = {r["product_id"]: r["note"] for r in got.select("product_id", "note").distinct().collect()}
    # the last bar of day 7 ends at midnight and so belongs to day 8
    assert notes == {"few": "ok", "enough": "ok"}
    assert got.where("product_id = 'few'").agg(F.max("n_days")).first()[0] == 8
    strict = volume_profile(bars, Settings(tod_rvol_min_days=9), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))
    assert strict.where("product_id = 'few'").first()["note"] == "insufficient_days(8)"
    none = volume_profile(bars, Settings(), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    assert {r["note"] for r in none.collect()} == {"insufficient_prior_days"}
