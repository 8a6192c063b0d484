"""The stateful stream of features against the batch plan, bar by bar."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.plans.features import indicators
from tidemark.schemas import CANDLES, FEATURES
from tidemark.streaming.features import Features, advance, features_of, frames, rolled, running_features, state_settings

START = dt.datetime(2024, 1, 1)


def bar(product, k, close, seq=0, volume=10.0):
    return (product, 300, START + dt.timedelta(minutes=5 * k), close - 0.5, close + 1.0 + k % 3, close - 1.5, close, volume + k % 7, seq)


def series(product, first, last):
    return [bar(product, k, 100.0 + k * 37 % 11 + (k // 9) % 5) for k in range(first, last)]


def run(spark, tmp_path, cfg, hold=3600.0):
    with state_settings(spark, drain=True):
        stream = spark.readStream.schema(CANDLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = running_features(stream, cfg, hold=hold).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/check")
        out.trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).start().awaitTermination()


def send(spark, tmp_path, rows):
    spark.createDataFrame(rows, CANDLES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def test_windows():
    x = np.array([1.0, 2.0, 4.0, 8.0])
    assert frames(x, 3).tolist()[3] == [2.0, 4.0, 8.0] and np.isnan(frames(x, 3)[0]).sum() == 2 and frames(x, 3, -1)[3].tolist() == [1.0, 2.0, 4.0]
    assert rolled(lambda w: np.nansum(w, 1), x, 3, 2).tolist()[1:] == [3.0, 7.0, 14.0] and np.isnan(rolled(lambda w: np.nansum(w, 1), x, 3, 2)[0])
    assert len(rolled(lambda w: np.nansum(w, 1), x[:0], 3, 2)) == 0


@pytest.mark.parametrize("mode", ["FIXED", "UTC_DAY_END"])
def test_pieces_of_any_length_equal_one_pass(mode):
    """A ring of 72 bars is enough: features of new bars do not change with where the batches end."""
    cfg, rng, last, rows = Settings(horizon_mode=mode), np.random.default_rng(3), None, []
    for k in range(300):
        o, c = rng.normal(100, 2, 2)
        one = (k * 300_000_000, o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, 1 + rng.random())
        now = advance(last, one)
        last = (*one[2:5], *now)
        rows.append((*one, *now))
    bars = np.array(rows)
    whole = features_of(bars, 0, cfg)
    for end in (73, 100, 177, 300):
        own = features_of(bars[end - 73 : end], end - 73, cfg)
        for f in FEATURES:
            assert own[f][-1] == pytest.approx(whole[f][end - 1], rel=1e-9, abs=1e-9), f


def test_stream_with_restart_late_and_repeated_bars_equals_batch(spark, tmp_path):
    cfg = Settings(liq_rolling_bars=5)
    a, b, c = series("a", 0, 150), series("b", 0, 90), series("c", 0, 3)
    send(spark, tmp_path, a[:4] + b[:80])  # a: fewer bars than its first price needs
    run(spark, tmp_path, cfg)
    first = spark.read.parquet(f"{tmp_path}/out")
    assert {r["product_id"] for r in first.select("product_id").distinct().collect()} == {"b"}
    null = ("b", 300, START + dt.timedelta(minutes=5 * 90), 1.0, 1.0, 1.0, None, 1.0, 0)
    send(spark, tmp_path, a[2:100] + b[60:] + [bar("b", 10, 999.0, 5), null])  # sent again, late, unusable
    send(spark, tmp_path, a[98:] + c)
    run(spark, tmp_path, cfg)  # a new query from the checkpoint
    live = {(r["product_id"], r["ts_end"]): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = indicators(spark.createDataFrame(a + b, CANDLES), cfg, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).collect()
    assert len(live) == len(batch) == 240 == spark.read.parquet(f"{tmp_path}/out").count()
    for r in batch:
        own = live[r["product_id"], r["ts_end"]]
        assert own["i"] == r["i"] and [own[f] for f in FEATURES] == pytest.approx([r[f] for f in FEATURES], rel=1e-8, abs=1e-8)


def test_a_timer_gives_out_bars_that_wait(spark, tmp_path):
    send(spark, tmp_path, series("c", 0, 3))
    run(spark, tmp_path, Settings(), hold=0.0)
    send(spark, tmp_path, series("d", 0, 1))
    run(spark, tmp_path, Settings(), hold=0.0)
    rows = spark.read.parquet(f"{tmp_path}/out").where("product_id = 'c'").orderBy("i").collect()
    assert [r["i"] for r in rows] == [0, 1, 2] and all(r["vwap"] == r["price"] for r in rows)
    send(spark, tmp_path, series("c", 3, 8))
    run(spark, tmp_path, Settings(), hold=3600.0)
    again = spark.read.parquet(f"{tmp_path}/out").where("product_id = 'c'").orderBy("i").collect()
    assert [r["i"] for r in again] == list(range(8))  # none twice


def test_windows_longer_than_the_ring_are_refused():
    with pytest.raises(ValueError, match="ring"):
        Features(Settings(liq_rolling_bars=72))
