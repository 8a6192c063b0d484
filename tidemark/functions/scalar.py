"""Scalar column functions. Missing values are NULL throughout; NaN is never produced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def ratio(a: Column, b: Column) -> Column:
    """a / (b + eps); NULL where the divisor is zero."""
    return F.try_divide(a, b + EPS)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.ln(q / (1 - q))


def bucket4(frac: Column) -> Column:
    """Quarter 0..3 of a fraction, clamped."""
    return F.least(F.lit(3), F.floor(clip(frac, 0.0, 1.0) * 4).cast("int"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def tod_frac(ts: Column) -> Column:
    return minute_of_day(ts) / 1440.0


def slot_5m(ts: Column) -> Column:
    """0..287; a bar that ends at midnight is slot 0 of the next day."""
    return F.floor(minute_of_day(ts) / 5).cast("int")


def minutes_between(a: Column, b: Column) -> Column:
    """b - a in minutes."""
    return F.timestamp_diff("SECOND", a, b) / 60.0


def minutes_to_day_end(ts: Column) -> Column:
    """To 23:59 of the same day, not below zero."""
    end = F.date_trunc("day", ts).cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS 59 MINUTES")
    return F.greatest(F.lit(0.0), minutes_between(ts, end))


def next_tick(ts: Column, minutes: int) -> Column:
    """First multiple of the interval in the day that lies strictly after ts."""
    steps = (F.floor(minute_of_day(ts) / minutes) + 1) * minutes
    return (F.date_trunc("day", ts) + F.make_dt_interval(mins=steps)).cast("timestamp_ntz")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def display_number(x: Column) -> Column:
    """Four decimals from 1 on, eight below."""
    return F.when(F.abs(x) >= 1, F.format_string("%.4f", x)).otherwise(F.format_string("%.8f", x))


def display_percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)
