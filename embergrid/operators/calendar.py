"""Calendars of the harmonized series: months, anomalies, climatology, trends, outlook.

Input ``series``: area, d, h (gap-free, one row per day). Windows are per area and bounded by the
calendar (about nine thousand days for a quarter century).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from embergrid.config import Config
from embergrid.functions.dates import day, day_key
from embergrid.functions.numbers import half_even, ratio

MONTHS = list(range(1, 13))


def centered_mean(series: DataFrame, cfg: Config) -> DataFrame:
    half = cfg.smooth_days // 2
    w = Window.partitionBy("area").orderBy("d").rowsBetween(-half, half)
    return series.withColumn("h7", F.avg("h").over(w))


def _full_years(col: Column, cfg: Config) -> Column:
    return col.between(cfg.first_full, cfg.last_full)


def month_totals(series: DataFrame) -> DataFrame:
    return series.groupBy("area", F.year("d").alias("y"), F.month("d").alias("mon")).agg(F.sum("h").alias("x"))


def month_matrix(series: DataFrame) -> DataFrame:
    """One row per area and year, one column per month; months outside the record stay NULL."""
    rows = month_totals(series).groupBy("area", "y").pivot("mon", MONTHS).agg(F.sum("x"))
    return rows.select("area", "y", *[half_even(F.col(str(m)), 1).alias(f"m{m:02d}") for m in MONTHS])


def month_normals(months: DataFrame, cfg: Config) -> DataFrame:
    """Mean and sample standard deviation of every calendar month over the complete years."""
    return months.filter(_full_years(F.col("y"), cfg)).groupBy("area", "mon").agg(
        F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd")
    )


def month_anomaly(months: DataFrame, normals: DataFrame) -> DataFrame:
    z = F.when(F.col("sd") > 0, (F.col("x") - F.col("mu")) / F.col("sd"))
    return months.join(normals, ["area", "mon"], "left").withColumn("z", z)


def unusual_months(anomalies: DataFrame, normals: DataFrame, cfg: Config) -> DataFrame:
    """Months at least ``unusual_z`` from normal that hold ``unusual_share`` of a normal year: strongest first, then oldest."""
    year_total = normals.groupBy("area").agg(F.sum("mu").alias("normal_year"))
    order = Window.partitionBy("area").orderBy(F.abs("z2").desc(), "y", "mon")
    return (
        anomalies.join(year_total, "area")
        .filter((F.abs("z") >= cfg.unusual_z) & (F.col("mu") >= F.greatest(F.lit(cfg.unusual_min), cfg.unusual_share * F.col("normal_year"))))
        .withColumn("z2", half_even(F.col("z"), 2))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= cfg.top_unusual)
        .select(
            "area", "rank", "y", "mon", F.col("z2").alias("z"),
            half_even(F.col("x"), 1).alias("value"), half_even(F.col("mu"), 1).alias("normal"),
        )
    )


def recent_unusual(unusual: DataFrame, cfg: Config) -> DataFrame:
    return unusual.filter(F.col("y") >= cfg.last_full - 4)


def doy_climatology(smoothed: DataFrame, cfg: Config) -> DataFrame:
    """Per folded "MM-dd": mean and quantiles across complete years of the smoothed series.

    A (year, key) pair with two days (28 and 29 February) is averaged first.
    """
    yearly = (
        smoothed.filter(_full_years(F.year("d"), cfg))
        .groupBy("area", day_key(F.col("d")).alias("key"), F.year("d").alias("y"))
        .agg(F.avg("h7").alias("x"))
    )
    return (
        yearly.groupBy("area", "key")
        .agg(F.avg("x").alias("mean"), F.expr("percentile(x, array(0.1, 0.5, 0.9))").alias("q"))
        .select("area", "key", "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))
    )


def yearly_totals(series: DataFrame, cfg: Config) -> DataFrame:
    """m, v, h per complete year; v is NULL before the fine era and in its partial first year."""
    v = F.when(F.make_date(F.col("y"), F.lit(1), F.lit(1)) >= day(cfg.fine_start), F.col("v"))
    return (
        series.groupBy("area", F.year("d").alias("y"))
        .agg(F.sum("m").alias("m"), F.sum("v").alias("v"), F.sum("h").alias("h"))
        .filter(_full_years(F.col("y"), cfg))
        .select(
            "area", "y",
            half_even(F.col("m"), 0).alias("m"), half_even(v, 0).alias("v"), half_even(F.col("h"), 0).alias("h"),
        )
    )


def busiest_quietest(normals: DataFrame, areas: DataFrame) -> DataFrame:
    """Three busiest months (only months with fire), three quietest (from the quietest up), share of a year."""
    shown = normals.select("area", "mon", half_even(F.col("mu"), 1).alias("mu"))
    down = Window.partitionBy("area").orderBy(F.col("mu").desc(), "mon")
    whole = Window.partitionBy("area")
    ranked = (
        shown.withColumn("r", F.row_number().over(down))
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("total", F.sum("mu").over(whole))
    )
    at = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.struct("r", "mon"))))
    top, low = F.col("r") <= 3, F.col("r") > F.col("n") - 3
    agg = ranked.groupBy("area").agg(
        F.transform(at(top & (F.col("mu") > 0)), lambda x: x["mon"]).alias("busiest"),
        F.transform(F.reverse(at(low)), lambda x: x["mon"]).alias("quietest"),
        half_even(100 * ratio(F.sum(F.when(top, F.col("mu"))), F.max("total")), 1).alias("busy_share"),
    )
    return areas.select("area").join(agg, "area").withColumn("busy_share", F.coalesce("busy_share", F.lit(0.0)))


def _slope(points: DataFrame, y: str, x: str, name: str) -> DataFrame:
    ok = points.filter(F.col(y).isNotNull())
    return ok.groupBy("area").agg(
        F.when(F.count(F.lit(1)) >= 5, F.regr_slope(F.col(y), F.col(x))).alias(f"{name}_slope"),
        F.when(F.count(F.lit(1)) >= 5, F.avg(y)).alias(f"{name}_mean"),
    )


def trends(yearly: DataFrame, seasons: DataFrame, areas: DataFrame) -> DataFrame:
    """Least-squares change per decade: burning (% of the mean), season onset and length (days)."""
    h = _slope(yearly, "h", "y", "h")
    timed = seasons.filter(F.col("start_off").isNotNull())
    onset, length = _slope(timed, "start_off", "start_year", "onset"), _slope(timed, "length", "start_year", "length")
    joined = areas.select("area")
    for part in (h, onset, length):
        joined = joined.join(part, "area", "left")
    pct = F.when(F.col("h_mean") > 0, F.col("h_slope") * 10 / F.col("h_mean") * 100)
    return joined.select(
        "area",
        half_even(pct, 3).alias("burning_pct_per_decade"),
        half_even(F.col("onset_slope") * 10, 3).alias("onset_days_per_decade"),
        half_even(F.col("length_slope") * 10, 3).alias("length_days_per_decade"),
    )


def outlook(climatology: DataFrame, today: dt.date) -> DataFrame:
    """Usual activity of the next 30 days against the last 30, as a change in percent."""
    # the same steps through a non-leap year: 29 February becomes 1 March
    base = dt.date(2001, 3, 1) if (today.month, today.day) == (2, 29) else today.replace(year=2001)
    keys = [((base + dt.timedelta(days=o)).strftime("%m-%d"), "next" if o > 0 else "past") for o in range(-30, 31) if o]
    side = F.create_map(*[F.lit(v) for k in keys for v in k])[F.col("key")]
    mean = half_even(F.col("mean"), 2)
    sums = climatology.groupBy("area").agg(
        F.coalesce(F.sum(F.when(side == "past", mean)), F.lit(0.0)).alias("past"),
        F.coalesce(F.sum(F.when(side == "next", mean)), F.lit(0.0)).alias("next"),
    )
    change = F.when(F.col("past") > 0, (F.col("next") - F.col("past")) / F.col("past") * 100)
    return sums.select(
        "area", half_even(F.col("past"), 4).alias("past"), half_even(F.col("next"), 4).alias("next"),
        half_even(change, 3).alias("change_pct"),
    )
