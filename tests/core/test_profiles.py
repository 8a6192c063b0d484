from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.plans.features import volume_profile
from tidemark.plans.profiles import ProfileStore
from tidemark.schemas import CANDLES
from tidemark.sources.candles import completed, keep_last
from tidemark.sources.versions import Store

CFG = Settings(tod_rvol_lookback_days=3, tod_rvol_min_days=2)
DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def candles(spark, days, product="a", seq=0, volume=10.0):
    """A bar that ends at midnight of each day, and two more."""
    rows = []
    for d in days:
        for minutes in (-5, 0, 600):
            at = dt.datetime.combine(day(d), dt.time()) + dt.timedelta(minutes=minutes)
            rows.append((product, 300, at, 1.0, 1.0, 1.0, 1.0, volume + d * 7 % 5 + minutes % 3, seq))
    return spark.createDataFrame(rows, CANDLES)


def whole(candles, k):
    at = F.lit(dt.datetime.combine(day(k), dt.time())).cast("timestamp_ntz")
    return sorted(map(tuple, volume_profile(completed(keep_last(candles), at), CFG, at).collect()), key=repr)


def test_days_one_by_one_equal_the_whole_profile(spark, tmp_path):
    store, kept = Store(spark, f"{tmp_path}/bars"), ProfileStore(spark, f"{tmp_path}/profile")
    assert kept.profile(CFG, day(0)).count() == 0
    every = candles(spark, range(6)).unionByName(candles(spark, (0, 4), "rare")).unionByName(candles(spark, (5,), "new"))
    store.merge(every)
    kept.add(store.read(), CFG, day(0), day(2))
    for k in (3, 4, 5):
        kept.add(store.read(), CFG, day(k))
    assert sorted(map(tuple, kept.profile(CFG, day(6)).collect()), key=repr) == whole(every, 6)
    # day 1 and 2 are nobody's any more; day 0 is one of the rare product's last days
    assert sorted(kept.log.latest()[1]["parts"]) == [f"day={day(k)}" for k in (0, 3, 4, 5)]
    # a day that is added again replaces itself
    late = every.unionByName(candles(spark, (5,), volume=90.0, seq=1))
    store.merge(candles(spark, (5,), volume=90.0, seq=1))
    kept.add(store.read(), CFG, day(5))
    assert sorted(map(tuple, kept.profile(CFG, day(6)).collect()), key=repr) == whole(late, 6)
    told = {r["product_id"]: r["note"] for r in kept.profile(CFG, day(6), spark.createDataFrame([("none",)], "product_id string")).where("slot IS NULL").collect()}
    assert told == {"new": "insufficient_days(1)", "none": "insufficient_prior_days"}
    before = kept.profile(CFG, day(6)).collect()
    kept.vacuum(keep=1, age=-5)
    assert sorted(before, key=repr) == sorted(kept.profile(CFG, day(6)).collect(), key=repr)


def test_a_new_day_reads_that_day(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/bars")
    store.merge(candles(spark, range(6)))
    own = ProfileStore.bars_of(store.read(), day(4), day(4))
    assert own.count() == 3 and own.columns == [c.split()[0] for c in CANDLES.split(", ")]
    plan = own._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.split("PartitionFilters: [")[1:]).split("], PushedFilters")[0]
    assert "day#" in filters and "2024-01-04" in filters and "2024-01-05" in filters
