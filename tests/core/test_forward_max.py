"""The forward maximum of blocks against every row's own window, and its time for a long horizon."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans.labels import forward_max, future_max
from tidemark.schemas import CANDLES

START = dt.datetime(2024, 1, 1)


def minutes(spark, lengths, gaps=True):
    rnd, rows = random.Random(7), []
    for p, n in lengths.items():
        at = START
        for k in range(n):
            high = float(rnd.randrange(1000))
            rows.append((p, 60, at, high, high, high, high, 1.0, k))
            at += dt.timedelta(minutes=1 + (rnd.randrange(4) if gaps else 0))
    return spark.createDataFrame(rows, CANDLES)


@pytest.mark.parametrize("horizon", [1, 2, 7, 64, 65, 500])
@pytest.mark.parametrize("chunk", [64, 2048])
def test_equals_each_rows_window(spark, horizon, chunk):
    lengths = {"a": 333, "b": 1, "c": 64, "d": 65, "e": 130}
    bars = minutes(spark, lengths)
    got = {(r["product_id"], r["i"]): r["h_future"] for r in forward_max(bars, horizon, chunk).collect()}
    want = {}
    for p in lengths:
        highs = [r["high"] for r in bars.where(F.col("product_id") == p).orderBy("ts_start").collect()]
        want |= {(p, i): max(highs[i : i + horizon]) for i in range(len(highs))}
    assert got == want


def test_columns_and_empty_table(spark):
    bars = minutes(spark, {"a": 5})
    out = future_max(bars, 3)
    assert out.columns == [*bars.columns, "i", "h_future"] and future_max(bars.limit(0), 3).count() == 0


def test_no_frame_grows_with_the_horizon(spark):
    """Every frame of the plan is a running one, an offset, or the whole partition."""
    plan = forward_max(minutes(spark, {"a": 50}), 10_000)._jdf.queryExecution().optimizedPlan().toString()
    frames = {f.split("))")[0] for f in plan.split("specifiedwindowframe(")[1:]}
    assert frames and all("10000" not in f and "9999" not in f or "9999, 9999" in f for f in frames)
