"""Bucket arithmetic: bucket b covers [(b - 1) * window, b * window)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, w: int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, F.lit(w))


def bucket(ts: Column, window: int) -> Column:
    return _div(ts, window) + 1


def bucket_start(b: Column, window: int) -> Column:
    return (b - 1) * window


def buckets_in(seconds: Column, window: int) -> Column:
    return _div(seconds, window)


def duration(n: Column, window: int) -> Column:
    return n * window


def floor_ts(ts: Column, window: int) -> Column:
    return _div(ts, window) * window
