"""The live feed as a stream: watermarked daily cell counts, deduplication, masks, windows.

State is bounded by the watermark: one row per (day, cell) inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from embergrid.config import Config
from embergrid.operators.grid import bin_cells, clean_live

FEED_METRICS = "feed"
FEED_DELAY = "8 days"  # the feed's own length: everything it still lists is accepted


def cleaned(stream: DataFrame, cfg: Config, delay: str = FEED_DELAY) -> DataFrame:
    """Usable detections with cells and a watermark on their time (``ts`` with a zone: UTC session)."""
    return bin_cells(clean_live(stream, cfg), cfg).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def cell_days(detections: DataFrame) -> DataFrame:
    """Tumbling days: d, yi, xi, n, frp."""
    return (
        detections.groupBy(F.window("ts", "1 day"), "yi", "xi")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("frp").alias("frp"))
        .select(F.col("window.start").cast("date").alias("d"), "yi", "xi", "n", "frp")
    )


def rolling_weeks(day_cells: DataFrame, days: int = 7) -> DataFrame:
    """Sliding windows of ``days`` days over the streamed day counts: first_day, yi, xi, n, frp.

    The stream keeps one row per day and cell; windows are sums of days, so no detection is multiplied.
    """
    spread = day_cells.withColumn("first_day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda b: F.date_sub("d", b))))
    return spread.groupBy("first_day", "yi", "xi").agg(F.sum("n").alias("n"), F.sum("frp").alias("frp"))


def week_counts(detections: DataFrame, days: int = 7) -> DataFrame:
    """Sliding windows of ``days`` days as stream state: first_day, yi, xi, n, frp. One row per window and cell inside the
    watermark is kept; with update mode a window's sum grows as detections come, days that are not over included."""
    return (
        detections.groupBy(F.window("ts", f"{days} days", "1 day"), "yi", "xi")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("frp").alias("frp"))
        .select(F.col("window.start").cast("date").alias("first_day"), "yi", "xi", "n", "frp")
    )


def complete_weeks(detections: DataFrame, days: int = 7) -> DataFrame:
    """``week_counts`` for append mode: each window once, when the watermark has passed its end.

    Two chained aggregations: days are summed first and, once complete, go into the windows that hold them. So no
    detection is multiplied, and a day's cell reaches ``days`` windows as one row each.
    """
    daily = detections.groupBy(F.window("ts", "1 day"), "yi", "xi").agg(F.count(F.lit(1)).alias("n"), F.sum("frp").alias("frp"))
    return (
        daily.groupBy(F.window("window", f"{days} days", "1 day"), "yi", "xi")
        .agg(F.sum("n").alias("n"), F.sum("frp").alias("frp"))
        .select(F.col("window.start").cast("date").alias("first_day"), "yi", "xi", "n", "frp")
    )


def measured(detections: DataFrame) -> DataFrame:
    """Detections whose number per batch the stream reports (see ``sink.run_measured``)."""
    return detections.observe(FEED_METRICS, F.count(F.lit(1)).alias("rows"), F.unix_micros(F.max("ts")).alias("newest"))


def deduplicated(detections: DataFrame, key: str = "det_id") -> DataFrame:
    """Re-sent rows and files count once inside the watermark."""
    return detections.dropDuplicatesWithinWatermark([key])


def masked(detections: DataFrame, mask: DataFrame) -> DataFrame:
    """Stream-static anti join with the industrial cells (static side first made distinct)."""
    return detections.join(mask.select("yi", "xi").distinct(), ["yi", "xi"], "left_anti")
