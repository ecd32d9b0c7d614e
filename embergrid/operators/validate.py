"""Skill of the calibration: cross-validation, fit, platform check, reliability flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from embergrid.config import Config
from embergrid.functions.dates import day
from embergrid.functions.labels import confidence_issues
from embergrid.functions.numbers import half_even, ratio
from embergrid.operators.harmonize import shrink


def cross_validate(monthly: DataFrame, cfg: Config, source: str = "m") -> DataFrame:
    """Leave-one-year-out for every area and year in one plan.

    The fit without a year is the total minus that year's part (exact: the sums are whole numbers), so
    nothing is refitted in a loop. Years with fewer than 12 overlap months are skipped.
    """
    prior = cfg.prior_k if source == "m" else cfg.prior_kt
    rows = monthly.filter("overlap")
    if source == "t":
        rows = rows.filter(F.col("month") < day(cfg.drift_from))
    rows = rows.select("area", "y", "mon", "v", F.col(source).alias("x"))
    area, year = Window.partitionBy("area"), Window.partitionBy("area", "y")
    month = Window.partitionBy("area", "mon")
    rest = lambda c: F.sum(c).over(area) - F.sum(c).over(year)
    k_area = shrink(rest("v"), rest("x"), cfg.lam_area, prior)
    fitted = (
        rows.withColumn("months", F.count(F.lit(1)).over(year))
        .withColumn("k_area", k_area)
        .withColumn(
            "k",
            shrink(
                F.sum("v").over(month) - F.col("v"), F.sum("x").over(month) - F.col("x"), cfg.lam_month, F.col("k_area")
            ),
        )
        .filter("months >= 12")
    )
    years = fitted.groupBy("area", "y").agg(
        F.sum("v").alias("o"), F.sum(F.col("x") * F.col("k")).alias("p"), F.sum("x").alias("r")
    )
    ape = F.abs(F.col("p") - F.col("o")) / F.col("o") * 100
    return years.select(
        "area", "y",
        half_even(F.col("o"), 1).alias("obs"),
        half_even(F.col("p"), 1).alias("pred"),
        half_even(F.col("r"), 1).alias("raw"),
        F.when(F.col("o") > 0, half_even(ape, 1)).alias("ape"),
    )


def cv_median_ape(cv: DataFrame, areas: DataFrame, name: str = "cv_median_ape") -> DataFrame:
    """Median of the rounded errors; areas without a testable year get NULL."""
    med = cv.groupBy("area").agg(half_even(F.expr("percentile(ape, 0.5)"), 1).alias(name))
    return areas.select("area").join(med, "area", "left")


def monthly_r2(monthly: DataFrame, ratios: DataFrame, areas: DataFrame) -> DataFrame:
    """1 - residual / total sum of squares over the overlap months (unrounded), and their fine total."""
    rows = monthly.filter("overlap").join(ratios.select("area", "mon", "k"), ["area", "mon"])
    rows = rows.withColumn("mean_v", F.avg("v").over(Window.partitionBy("area")))
    sums = rows.groupBy("area").agg(
        F.sum(F.pow(F.col("v") - F.col("m") * F.col("k"), 2)).alias("res"),
        F.sum(F.pow(F.col("v") - F.col("mean_v"), 2)).alias("tot"),
        F.sum("v").alias("overlap_cell_days"),
    )
    return areas.select("area").join(sums, "area", "left").select(
        "area",
        F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).alias("r2"),
        F.coalesce("overlap_cell_days", F.lit(0.0)).alias("overlap_cell_days"),
    )


def platform_check(flagged: DataFrame, ratios: DataFrame, areas: DataFrame, cfg: Config) -> DataFrame:
    """Median yearly disagreement (%) of the two coarse reconstructions while both platforms flew."""
    days = flagged.filter(
        (F.col("d") >= day(cfg.check_from)) & (F.year("d") < cfg.fine_start.year) & ~F.col("out")
    ).withColumn("mon", F.month("d"))
    years = (
        days.join(ratios.select("area", "mon", "k", "kt"), ["area", "mon"])
        .groupBy("area", F.year("d").alias("y"))
        .agg(F.sum(F.col("m") * F.col("k")).alias("a"), F.sum(F.col("t") * F.col("kt")).alias("b"))
        .filter("a > 0")
    )
    med = years.withColumn("e", F.abs(F.col("b") - F.col("a")) / F.col("a") * 100).groupBy("area").agg(
        half_even(F.expr("percentile(e, 0.5)"), 1).alias("platform_check_ape")
    )
    return areas.select("area").join(med, "area", "left")


def reliability(r2: DataFrame, cv: DataFrame, cfg: Config) -> DataFrame:
    """low_counts flag and its reasons per area (``cv``: area, cv_median_ape)."""
    n, r, c = F.col("overlap_cell_days"), F.col("r2"), F.col("cv_median_ape")
    low = (n < cfg.min_overlap) | r.isNull() | (r < cfg.min_r2) | c.isNull() | (c > cfg.max_cv)
    return r2.join(cv, "area").select(
        "area",
        half_even(n, 0).alias("overlap_cell_days"),
        half_even(r, 3).alias("r2_monthly"),
        "cv_median_ape",
        low.alias("low_counts"),
        confidence_issues(half_even(n, 0), half_even(r, 3), c, cfg).alias("issues"),
    )


def overlap_scatter(monthly: DataFrame) -> DataFrame:
    return monthly.filter("overlap").select(
        "area", "month", half_even(F.col("m"), 1).alias("coarse"), half_even(F.col("v"), 1).alias("fine"), "mon"
    )


def outage_report(flagged: DataFrame, cfg: Config) -> DataFrame:
    """Per area, the days by how they were read, as sorted arrays."""
    early = F.col("d") < day(cfg.fine_start)
    kinds = {
        "fine_gaps": F.col("gap") & ~F.col("unknown"),
        "fine_strips": F.col("strip"),
        "a_only": F.col("b_out") & (early | F.col("gap")) & ~F.col("unknown"),
        "no_record": F.col("unknown"),
    }
    # at most one entry per day of the record in each array
    return flagged.groupBy("area").agg(
        *[F.sort_array(F.collect_list(F.when(cond, F.col("d")))).alias(k) for k, cond in kinds.items()]
    )


def sensor_ratio_stats(bands: DataFrame, calendar: DataFrame, cfg: Config) -> DataFrame:
    """Yearly fine / platform-A ratio (outage days out), with the mean and spread before the drift date."""
    s, n = F.col("s"), F.col("n")
    ok = bands.filter(F.col("d") >= day(cfg.pooled_from)).join(F.broadcast(calendar.select("d")), "d", "left_anti")
    years = (
        ok.groupBy(F.year("d").alias("y"))
        .agg(F.sum(F.when(s == 1, n)).alias("fine"), F.sum(F.when(s == 2, n)).alias("a"))
        .withColumn("ratio", ratio(F.col("fine"), F.col("a")))
    )
    stable = F.when(F.col("y") < cfg.drift_from.year, F.col("ratio"))
    everything = Window.partitionBy(F.lit(1))  # one row per year
    return years.select(
        "y", "fine", "a",
        half_even(F.col("ratio"), 4).alias("ratio"),
        half_even(F.avg(stable).over(everything), 4).alias("mean_before_drift"),
        half_even(F.stddev_samp(stable).over(everything), 4).alias("sd_before_drift"),
    )
