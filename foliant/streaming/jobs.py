"""Streaming forms: request rates, keyed writes of micro-batches, and the sweep of old artifacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.history import newest_per_key


def rate_breaches(requests: DataFrame, at: str, client: str, allowed: int, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(client, window_start, requests) of the windows with more than ``allowed`` requests; a stream keeps a window
    open for ``late``."""
    held = requests.withWatermark(at, late) if requests.isStreaming else requests
    counted = held.groupBy(F.window(at, window).alias("_w"), client).agg(F.count(F.lit(1)).alias("requests"))
    return counted.where(F.col("requests") > allowed).select(client, F.col("_w.start").alias("window_start"), "requests")


def batch_writer(write: Callable[[DataFrame], None], keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands on the newest row of each key of a micro-batch, so that a repeated batch changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        write(newest_per_key(batch, keys, [F.desc(order)]))

    return apply


def expired(artifacts: DataFrame, modified: str, now, days: int) -> DataFrame:
    """The artifacts last changed before ``days`` days before ``now``; 0 days keep everything."""
    if days <= 0:
        return artifacts.limit(0)
    return artifacts.where(F.col(modified) < F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))
