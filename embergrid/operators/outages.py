"""Days a sensor recorded far less than its usual share, and the pooled calibration prior.

Windows here run over one row per day (or per day and longitude band), after aggregation: their
size is bounded by the calendar, whatever the number of detections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from embergrid.config import Config
from embergrid.functions.cells import floor_div
from embergrid.functions.dates import day
from embergrid.functions.numbers import half_even, ratio


def band_counts(grid: DataFrame, cfg: Config) -> DataFrame:
    """Cell rows per day, sensor and longitude band."""
    return grid.groupBy("d", "s", floor_div(F.col("xi"), cfg.strip_cells).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _spine(bounds: DataFrame, lo: Column, hi: Column, *keys: str) -> DataFrame:
    return bounds.filter(lo <= hi).select(*keys, F.explode(F.sequence(lo, hi, F.expr("interval 1 day"))).alias("d"))


def world_daily(bands: DataFrame) -> DataFrame:
    """All areas together: coarse m, fine v, platform A t for every day of the record, 0-filled."""
    s, n = F.col("s"), F.col("n")
    daily = bands.groupBy("d").agg(*[F.sum(F.when(s == code, n)).alias(c) for code, c in ((0, "m"), (1, "v"), (2, "t"))])
    bounds = bands.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return (
        _spine(bounds, F.col("lo"), F.col("hi"))
        .join(daily, "d", "left")
        .select("d", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("m", "v", "t")])
    )


def usual(x: str, cfg: Config, *keys: str) -> Column:
    """Centred rolling median of a gap-free daily column, NULL below the minimum of known values."""
    half = cfg.usual_days // 2
    w = Window.partitionBy(*keys).orderBy("d").rowsBetween(-half, half)
    return F.when(
        F.count(F.col(x)).over(w) >= cfg.usual_min_days, F.expr(f"percentile({x}, 0.5)").over(w)
    )


def rolling_median(daily: DataFrame, x: str, cfg: Config) -> DataFrame:
    return daily.select("d", x, usual(x, cfg).alias("usual"))


def _fine_gap(cfg: Config) -> Column:
    """Condition on a world series: the fine sensor far under its usual ratio on an ordinary day.

    The ratio is NULL before the fine era, so the rolling median sees only days both could fly.
    """
    return F.coalesce(
        (F.col("m") >= cfg.gap_min_coarse) & (F.col("r") < cfg.gap_share * usual("r", cfg)), F.lit(False)
    )


def _with_ratio(daily: DataFrame, cfg: Config) -> DataFrame:
    return daily.withColumn("r", F.when(F.col("d") >= day(cfg.fine_start), ratio(F.col("v"), F.col("m"))))


def fine_gaps(daily: DataFrame, cfg: Config) -> DataFrame:
    """Days the fine sensor was out everywhere."""
    return _with_ratio(daily, cfg).withColumn("fine_out", _fine_gap(cfg)).filter("fine_out").select("d")


def fine_strips(bands: DataFrame, gaps: DataFrame, cfg: Config) -> DataFrame:
    """(d, band) pairs where the fine sensor was out over a longitude band only."""
    two = bands.filter(F.col("s") < 2)
    everywhere = Window.partitionBy(F.lit(1))  # one row per band
    ends = two.groupBy("band").agg(F.max("d").alias("hi")).withColumn("hi", F.max("hi").over(everywhere))
    wide = two.groupBy("d", "band").agg(
        F.sum(F.when(F.col("s") == 0, F.col("n"))).alias("m"), F.sum(F.when(F.col("s") == 1, F.col("n"))).alias("v")
    )
    spine = _spine(ends, day(cfg.fine_start), F.col("hi"), "band")
    filled = spine.join(wide, ["d", "band"], "left").select(
        "d", "band", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("m", "v")]
    )
    return (
        filled.withColumn("r", ratio(F.col("v"), F.col("m")))
        .withColumn("u", usual("r", cfg, "band"))
        .filter((F.col("m") >= cfg.strip_min_coarse) & (F.col("r") < cfg.strip_share * F.col("u")))
        .join(F.broadcast(gaps), "d", "left_anti")
        .select("d", "band")
    )


def coarse_flags(daily: DataFrame, cfg: Config, *keep: str) -> DataFrame:
    """(d, coarse_out, b_out): the coarse record or its platform A part out; its platform B part out."""
    share = lambda c: F.col(c) < cfg.gap_share * F.col(f"u_{c}")
    no = lambda c: F.coalesce(c, F.lit(False))
    low = daily.withColumn("u_m", usual("m", cfg)).withColumn(
        "low", no(share("m") & (F.col("u_m") >= cfg.gap_min_coarse))
    )
    era = low.withColumn("era", (F.col("d") >= day(cfg.platform_b_start)) & ~F.col("low"))
    shares = era.withColumn("a", F.when(F.col("era"), ratio(F.col("t"), F.col("m")))).withColumn("b", 1 - F.col("a"))
    flagged = shares.withColumns({"u_a": usual("a", cfg), "u_b": usual("b", cfg)}).withColumn(
        "coarse_out", F.col("low") | (F.col("era") & no(share("a")))
    )
    return flagged.select(
        "d", *keep, "coarse_out", (F.col("era") & ~F.col("coarse_out") & no(share("b"))).alias("b_out")
    )


def coarse_outages(daily: DataFrame, cfg: Config) -> DataFrame:
    return coarse_flags(daily, cfg).filter("coarse_out").select("d")


def platform_b_outages(daily: DataFrame, cfg: Config) -> DataFrame:
    return coarse_flags(daily, cfg).filter("b_out").select("d")


def outage_calendar(daily: DataFrame, cfg: Config) -> DataFrame:
    """One row per affected day: fine_out, coarse_out, b_out, unknown (no usable record at all).

    All four rolling medians share one ordering of the daily rows.
    """
    with_gap = _with_ratio(daily, cfg).withColumn("fine_out", _fine_gap(cfg))
    return with_unknown(coarse_flags(with_gap, cfg, "fine_out").filter("coarse_out or b_out or fine_out"), cfg)


def with_unknown(calendar: DataFrame, cfg: Config) -> DataFrame:
    return calendar.withColumn(
        "unknown", F.col("coarse_out") & ((F.col("d") < day(cfg.fine_start)) | F.col("fine_out"))
    )


def exclude_outages(bands: DataFrame, calendar: DataFrame, strips: DataFrame) -> DataFrame:
    """Band counts without outage days and lost strips (both bounded by the calendar: broadcast)."""
    return bands.join(F.broadcast(calendar.select("d")), "d", "left_anti").join(
        F.broadcast(strips.select("d", "band")), ["d", "band"], "left_anti"
    )


def pooled_prior(bands: DataFrame, calendar: DataFrame, strips: DataFrame, cfg: Config) -> DataFrame:
    """Pooled fine/coarse and fine/platform-A ratios over the overlap, outages left out."""
    ok = exclude_outages(bands, calendar, strips).filter(F.col("d") >= day(cfg.pooled_from))
    s, n = F.col("s"), F.col("n")
    before = F.col("d") < day(cfg.drift_from)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")
    sums = ok.agg(
        total(s == 1).alias("fine"),
        total(s == 0).alias("coarse"),
        total((s == 1) & before).alias("fine_before_drift"),
        total((s == 2) & before).alias("a_before_drift"),
    )
    return sums.select(
        half_even(ratio(F.col("fine"), F.col("coarse")), 4).alias("k"),
        half_even(ratio(F.col("fine_before_drift"), F.col("a_before_drift")), 4).alias("kt"),
        "*",
    )
