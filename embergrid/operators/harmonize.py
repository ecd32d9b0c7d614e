"""Two sensors -> one daily series per area.

Daily series columns: area, d, m, v, t (cell-days of coarse, fine, platform A), *_det, *_frp, mg.
NULL means "no record", 0 means "no fire". All windows are per area over at most one row per day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from embergrid.config import Config
from embergrid.functions.dates import day, day_key
from embergrid.functions.numbers import half_even, ratio, settled

COUNTS = ("m", "v", "t")


def date_spine(areas: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return areas.select("area", F.explode(F.sequence(day(start), day(end), F.expr("interval 1 day"))).alias("d"))


def date_spine_join(daily: DataFrame, areas: DataFrame, calendar: DataFrame, cfg: Config) -> DataFrame:
    """Gap-free series for every catalogued area, also those without a single record.

    The outage calendar has at most one row per day of the record, so it is broadcast.
    """
    spine = date_spine(areas, cfg.coarse_start, cfg.record_end)
    cols = [f"{c}{x}" for c in COUNTS for x in ("", "_det", "_frp")] + ["mg"]
    flags = ("fine_out", "coarse_out", "b_out", "unknown")
    joined = (
        spine.join(daily, ["area", "d"], "left")
        .join(F.broadcast(calendar.select("d", *flags)), "d", "left")
        .withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})
    )
    seen = (F.col("d") >= day(cfg.fine_start)) & ~F.col("fine_out")
    out = []
    for c in cols:
        filled = F.coalesce(F.col(c), F.lit(0.0))
        out.append((F.when(seen, filled) if c.startswith("v") else filled).alias(c))
    return joined.select("area", "d", *out, *flags)


def flag_days(series: DataFrame, cfg: Config) -> DataFrame:
    """gap: fine out everywhere; strip: fine lost part of the area; out: left out of every comparison."""
    fine_era = F.col("d") >= day(cfg.fine_start)
    return (
        series.withColumn("gap", fine_era & F.col("v").isNull())
        .withColumn("strip", fine_era & ~F.col("gap") & (F.col("mg") > 0))
        .withColumn("out", F.col("gap") | F.col("strip") | F.col("b_out") | F.col("coarse_out"))
    )


def monthly_sums(flagged: DataFrame, cfg: Config) -> DataFrame:
    """Calendar-month sums of comparable days; NULL only when every day is NULL."""
    fit = lambda c: F.sum(F.when(~F.col("out"), F.col(c))).alias(c)
    return (
        flagged.groupBy("area", F.trunc("d", "month").alias("month"))
        .agg(*[fit(c) for c in COUNTS])
        .select(
            "area", "month", F.year("month").alias("y"), F.month("month").alias("mon"), *COUNTS,
            ((F.col("month") >= day(cfg.overlap_from)) & F.col("v").isNotNull()).alias("overlap"),
        )
    )


def shrink(fine: Column, other: Column, weight: float, toward) -> Column:
    return (fine + weight * toward) / (other + weight)


def fit_ratios(monthly: DataFrame, areas: DataFrame, cfg: Config) -> DataFrame:
    """(area, mon, k_area, k, kt_area, kt): month ratios shrunk to the area's, that one to the prior."""
    before = F.col("month") < day(cfg.drift_from)
    by_month = (
        monthly.filter("overlap")
        .groupBy("area", "mon")
        .agg(
            F.sum("v").alias("v"), F.sum("m").alias("m"),
            F.sum(F.when(before, F.col("v"))).alias("vt"), F.sum(F.when(before, F.col("t"))).alias("t"),
        )
    )
    spine = areas.select("area", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mon"))
    sums = spine.join(by_month, ["area", "mon"], "left").na.fill(0.0, ["v", "m", "vt", "t"])
    whole = Window.partitionBy("area")
    tot = lambda c: F.sum(c).over(whole)
    return (
        sums.withColumn("k_area", shrink(tot("v"), tot("m"), cfg.lam_area, cfg.prior_k))
        .withColumn("kt_area", shrink(tot("vt"), tot("t"), cfg.lam_area, cfg.prior_kt))
        .select(
            "area", "mon", "k_area",
            shrink(F.col("v"), F.col("m"), cfg.lam_month, F.col("k_area")).alias("k"),
            "kt_area",
            shrink(F.col("vt"), F.col("t"), cfg.lam_month, F.col("kt_area")).alias("kt"),
        )
    )


def harmonize_daily(flagged: DataFrame, ratios: DataFrame, cfg: Config) -> DataFrame:
    """Adds h0: every day read from the sensor that recorded it, in fine-sensor units."""
    a_only = F.col("t") * F.col("kt")
    coarse = F.when(F.col("b_out"), a_only).otherwise(F.col("m") * F.col("k"))
    h = (
        F.when(F.col("d") < day(cfg.platform_b_start), a_only)
        .when((F.col("d") < day(cfg.fine_start)) | F.col("gap"), coarse)
        .otherwise(F.col("v") + F.col("mg") * F.col("k"))
    )
    return (
        flagged.withColumn("mon", F.month("d"))
        .join(ratios.select("area", "mon", "k", "kt"), ["area", "mon"])
        .withColumn("h0", h)
    )


def fill_no_record(harmonized: DataFrame) -> DataFrame:
    """Adds h: days without any record get the area's usual fire for the date at the month's level.

    Hashing on area alone serves both windows (and any later one by area) with one shuffle; every area
    has the same number of days, so no partition is hot.
    """
    known = F.when(~F.col("unknown"), F.col("h0"))
    by_key = Window.partitionBy("area", "key")
    by_month = Window.partitionBy("area", F.trunc("d", "month"))
    rated = (
        harmonized.repartition("area")
        .withColumn("key", day_key(F.col("d")))
        .withColumn("clim", F.coalesce(F.avg(known).over(by_key), F.lit(0.0)))
        .withColumn("recorded", F.coalesce(F.sum(known).over(by_month), F.lit(0.0)))
        .withColumn("expected", F.sum(F.when(~F.col("unknown"), F.col("clim"))).over(by_month))
    )
    level = F.coalesce(ratio(F.col("recorded"), F.col("expected")), F.lit(1.0))
    return rated.withColumn("h", F.when(F.col("unknown"), F.col("clim") * level).otherwise(F.col("h0"))).drop(
        "clim", "recorded", "expected"
    )


def no_record_scale(series: DataFrame) -> DataFrame:
    """Per month that holds unknown days: total over recorded (1 where nothing was recorded)."""
    sums = series.groupBy("area", F.year("d").alias("y"), F.month("d").alias("mon")).agg(
        F.sum("h").alias("total"),
        F.sum(F.when(~F.col("unknown"), F.col("h"))).alias("recorded"),
        F.bool_or("unknown").alias("any_unknown"),
    )
    scale = F.when(F.col("recorded") > 0, half_even(F.col("total") / F.col("recorded"), 4)).otherwise(F.lit(1.0))
    return sums.filter("any_unknown").select("area", "y", "mon", scale.alias("scale"))


def total_activity(series: DataFrame) -> DataFrame:
    return series.groupBy("area").agg(half_even(F.sum("h"), 0).alias("total_cell_days"))


def daily_export(series: DataFrame, cfg: Config) -> DataFrame:
    """date, coarse, fine, harmonized, frp and the sensor that supplied the day."""
    from embergrid.functions.labels import source_label

    frp = F.when(F.col("d") < day(cfg.fine_start), F.col("m_frp")).otherwise(F.col("v_frp"))
    return series.select(
        "area", "d",
        half_even(F.col("m"), 1).alias("coarse_cell_days"),
        half_even(F.col("v"), 1).alias("fine_cell_days"),
        half_even(F.col("h"), 2).alias("harmonized_cell_days"),
        settled(frp, 0).alias("frp_mw"),
        source_label(cfg).alias("source"),
    )
