"""Continuous audit of pages as crawl drops arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.signals import page_signals


def daily_page_audit(
    pages: DataFrame, as_of="2025-06-01 00:00:00", late: str = "2 days", window: str = "1 day"
) -> DataFrame:
    """Pages, pages that fail basic checks, and stale pages per site and day of fetching.

    ``pages`` is a streaming (or plain) table with ``fetched_at``. Pages delivered twice count once; rows later than
    the watermark are dropped. The HTML is reduced to three flags before anything is shuffled. State is one narrow row
    per page within the watermark and one per open (site, day).
    """
    fresh = _flags(pages, as_of).withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(PAGE)
    return _daily(fresh, window)


def daily_page_audit_batch(pages: DataFrame, as_of="2025-06-01 00:00:00", window: str = "1 day") -> DataFrame:
    """The same table from a finished crawl."""
    return _daily(_flags(pages, as_of).dropDuplicates(PAGE), window)


PAGE = ["site", "page_id", "fetched_at"]


def _flags(pages: DataFrame, as_of) -> DataFrame:
    """A projection: page, time, whether it fails a basic check, whether it is stale."""
    poor = ~F.col("has_lang") | F.col("skips_level") | (F.col("n_landmarks") < 3)
    return page_signals_with_time(pages, as_of).select(*PAGE, poor.alias("is_poor"), "is_stale")


def _daily(flags: DataFrame, window: str) -> DataFrame:
    return (
        flags.groupBy("site", F.window("fetched_at", window).alias("w"))
        .agg(
            F.count("*").alias("pages"),
            F.count_if("is_poor").alias("poor_pages"),
            F.count_if("is_stale").alias("stale_pages"),
        )
        .select("site", F.col("w.start").alias("day"), "pages", "poor_pages", "stale_pages")
    )


def page_signals_with_time(pages: DataFrame, as_of) -> DataFrame:
    """Signals next to ``fetched_at``; a projection, so it works on streams."""
    return page_signals(pages, as_of, keep=("fetched_at",))


def start_daily_audit(pages: DataFrame, out: str, checkpoint: str, available_now: bool = True, **options):
    """Append closed days to Parquet."""
    writer = (
        daily_page_audit(pages, **options)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
