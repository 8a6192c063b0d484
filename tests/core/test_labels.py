from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tidemark.operators.asof import forward_asof
from tidemark.plans.labels import future_max, labels

START = dt.datetime(2024, 1, 1)


def minutes(spark, highs, product="a", gap_at=None):
    rows = []
    for i, h in enumerate(highs):
        shift = 3 * 1440 if gap_at is not None and i >= gap_at else 0
        rows.append((product, 60, START + dt.timedelta(minutes=i + shift), h, h, h, h, 1.0, i))
    return spark.createDataFrame(rows, "product_id string, granularity_sec int, ts_start timestamp_ntz, open double, high double, low double, close double, volume double, ingest_seq long")


@pytest.mark.parametrize("chunk", [8192, 16])
def test_future_max_across_chunks(spark, chunk):
    h = np.random.default_rng(0).random(500).tolist()
    got = {r["i"]: r["h_future"] for r in future_max(minutes(spark, h), 12, chunk=chunk).collect()}
    assert got == {i: max(h[i : i + 12]) for i in range(500)}


def test_asof_over_gaps_and_past_the_end(spark):
    h = np.random.default_rng(1).random(300).tolist()
    right = minutes(spark, h, gap_at=200)
    times = [t["ts_start"] for t in sorted(right.collect(), key=lambda r: r["ts_start"])]
    asked = [START + dt.timedelta(minutes=37 * k - 60, seconds=30) for k in range(250)]
    left = spark.createDataFrame([("a", t, k) for k, t in enumerate(asked)] + [("other", START, -1)], "product_id string, ts_end timestamp_ntz, k int")
    got = {r["k"]: r["high"] for r in forward_asof(left, right.select("product_id", "ts_start", "high"), "ts_end", "ts_start", "high").collect()}
    at = np.searchsorted(np.array(times, "datetime64[us]"), np.array(asked, "datetime64[us]"))
    assert got == {**{k: h[min(i, 299)] for k, i in enumerate(at)}, -1: None}


def test_labels_censoring_and_monotony(spark):
    h = (100 + np.cumsum(np.random.default_rng(2).normal(0, 1, 400))).tolist()
    left = spark.createDataFrame([("a", START + dt.timedelta(minutes=5 * k), 100.0) for k in range(80)], "product_id string, ts_end timestamp_ntz, price double")
    got = labels(left, minutes(spark, h), 60).collect()
    assert len(got) == 80 and all(r["y2"] <= r["y1"] for r in got)
    assert len(labels(left, minutes(spark, h), 60, drop_censored=True).collect()) == (400 - 60) // 5 + 1
    longer = {r["ts_end"]: r["y1"] for r in labels(left, minutes(spark, h), 120).collect()}
    assert all(r["y1"] <= longer[r["ts_end"]] for r in got)
    by_time = {r["ts_end"]: r["h_future"] for r in labels(left, minutes(spark, h), 60, by_time=True).collect()}
    assert by_time == {r["ts_end"]: r["h_future"] for r in got}
