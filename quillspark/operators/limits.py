"""Sliding-window request limiter."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.folds import ordered_fold


def decide(times: list[float], now: float, limit: int, window: float) -> int | None:
    """Seconds to wait, or None with now added to times (accepted ones in the window, oldest first)."""
    while times and times[0] <= now - window:
        times.pop(0)
    if len(times) >= limit:
        return max(1, math.floor(times[0] + window - now + 0.999))
    times.append(now)
    return None


def limited(requests: DataFrame, limit: int = 30, window: float = 60) -> DataFrame:
    """[J4] identity, request_id, ts, accepted, retry_seconds: only accepted requests count against the limit.

    An ordered fold for each identity; a window count isn't the same. Rows go through once, in time order.
    """

    def step(times: list[float], row: dict) -> tuple:
        wait = decide(times, row["seconds"], limit, window)
        return row["identity"], row["request_id"], row["ts"], wait is None, wait

    rows = requests.select("identity", "request_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return ordered_fold(rows, "identity", ["ts", "request_id"], "identity long, request_id long, ts timestamp_ntz, accepted boolean, retry_seconds long", list, step)
