"""Streaming twins of the log operators.

Uniqueness holds within the watermark only: replays and conflicts of older rows are found by the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_replays(events: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """Exact replays within the watermark dropped; the keys should hold the content's hash."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def running_ledger(calls: DataFrame) -> DataFrame:
    """Calls and milliseconds of each document and page so far; run in update or complete mode."""
    return calls.groupBy("doc_id", "page_index").agg(F.count("*").alias("calls"), F.sum("duration_ms").alias("total_ms"))


def preview_heads(revisions: DataFrame) -> DataFrame:
    """The latest revision of each document."""
    return revisions.groupBy("doc_id").agg(F.max_by("content", "revision").alias("content"), F.max("revision").alias("revision"))


def lease_tenures(events: DataFrame, keys: list[str], ts: str, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """Sessions of acquisitions and renewals, complete once the watermark has passed."""
    window = F.session_window(ts, f"{seconds} seconds")
    return events.withWatermark(ts, late).groupBy(*keys, window).agg(F.count("*").alias("renewals")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "renewals")
