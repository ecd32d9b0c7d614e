"""Fire seasons: where the year is quietest, season totals, timing, critical period, busiest weeks.

The mean year is a ring of at most 365 keys per area, so its windows are small; circular frames are
ordinary frames over the ring laid out three times.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from embergrid.config import Config
from embergrid.functions.dates import day, day_key, key_date
from embergrid.functions.numbers import half_even


def ring_sums(climatology: DataFrame, width: int) -> DataFrame:
    """(area, i, n, key, total): circular sums of ``mean`` over ``width`` days around every key."""
    half = width // 2
    area = Window.partitionBy("area")
    ring = climatology.select(
        "area", "key", F.col("mean"),
        (F.row_number().over(area.orderBy("key")) - 1).alias("i"),
        F.count(F.lit(1)).over(area).alias("n"),
    )
    laid = ring.withColumn("lap", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(
        "pos", F.col("i") + F.col("lap") * F.col("n")
    )
    frame = area.orderBy("pos").rowsBetween(-half, half)
    return (
        laid.withColumn("total", half_even(F.sum("mean").over(frame), 9))
        .filter("lap = 0")
        .select("area", "i", "n", "key", "total")
    )


def season_start(climatology: DataFrame, areas: DataFrame, cfg: Config) -> DataFrame:
    """(area, season_start): middle of the quietest stretch of the mean year.

    Days that tie form runs around the ring; the middle of the longest run (the earliest of equals,
    scanning from a day outside every run) wins. All tied: the first key. No mean year: "01-01".
    """
    area = Window.partitionBy("area")
    tied = ring_sums(climatology, cfg.quiet_days).withColumn("tied", F.col("total") == F.min("total").over(area))
    turned = tied.withColumn("f", F.min(F.when(~F.col("tied"), F.col("i"))).over(area)).withColumn(
        "p", F.pmod(F.col("i") - F.col("f") - 1, F.col("n"))
    )
    # a run of tied days keeps the same difference between place and rank; every window below clusters
    # on area first, so the ring is shuffled once
    in_order = Window.partitionBy("area", "tied").orderBy("p")
    run = Window.partitionBy("area", "tied", "run")
    runs = turned.withColumn("run", F.col("p") - F.row_number().over(in_order)).withColumns(
        {"length": F.count(F.lit(1)).over(run), "first": F.min("p").over(run)}
    )
    longest = F.max(F.when(F.col("tied"), F.struct(F.col("length"), -F.col("first")))).over(area)
    middle = F.floor((F.col("longest")["length"] - 1) / 2) - F.col("longest")["col2"]
    best = F.when(F.col("f").isNull(), F.lit(0)).otherwise(F.pmod(F.col("f") + 1 + middle, F.col("n")))
    found = runs.withColumn("longest", longest).filter(F.col("i") == best).select("area", F.col("key").alias("k"))
    return (
        areas.select("area")
        .join(found, "area", "left")
        .select("area", F.coalesce("k", F.lit("01-01")).alias("season_start"))
    )


def season_label(start: Column, key: Column) -> Column:
    """One year when at least 95 % of the season falls in it (it starts by 19 January), else two."""
    y = F.year(start)
    two = F.concat(y.cast("string"), F.lit("–"), F.substring((y + 1).cast("string"), 3, 2))
    return F.when(key.between("01-01", "01-19"), y.cast("string")).otherwise(two)


def season_assign(smoothed: DataFrame, starts: DataFrame, cfg: Config) -> DataFrame:
    """Series rows that fall in a whole season: adds start_year, season_from, season_to, label.

    The season of a day is arithmetic on its "MM-dd" (no range join).
    """
    md = F.date_format("d", "MM-dd")
    y = F.year("d") - F.when(md < F.col("season_start"), 1).otherwise(0)
    return (
        smoothed.join(starts, "area")
        .withColumn("start_year", y)
        .withColumn("season_from", key_date(F.col("start_year"), F.col("season_start")))
        .withColumn("season_to", F.date_sub(key_date(F.col("start_year") + 1, F.col("season_start")), 1))
        .filter((F.col("season_from") >= day(cfg.coarse_start)) & (F.col("season_to") <= day(cfg.record_end)))
        .withColumn("label", season_label(F.col("season_from"), F.col("season_start")))
    )


def season_timing(assigned: DataFrame, cfg: Config) -> DataFrame:
    """One row per season: total, and for seasons with enough fire the days that open, top and close it."""
    season = Window.partitionBy("area", "start_year")
    running = season.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    days = (
        assigned.withColumn("raw", F.sum("h").over(season))
        .withColumn("share", F.try_divide(F.sum("h").over(running), F.col("raw")))
        .withColumn("peak_at", F.struct(-half_even(F.col("h7"), 9), F.col("d").alias("pd")))
    )
    timed = F.col("raw") >= cfg.season_min_total
    first = lambda share: F.min(F.when(timed & (F.col("share") >= share - 1e-9), F.col("d")))
    rows = days.groupBy("area", "start_year", "label", "season_from").agg(
        half_even(F.max("raw"), 1).alias("total"),
        first(0.1).alias("start"),
        F.min(F.when(timed, F.col("peak_at")))["pd"].alias("peak"),
        first(0.9).alias("end"),
    )
    off = lambda c: F.datediff(F.col(c), F.col("season_from"))
    return rows.select(
        "area", "start_year", "label", "season_from", "total", "start", "peak", "end",
        off("start").alias("start_off"), off("peak").alias("peak_off"), off("end").alias("end_off"),
        (F.datediff("end", "start") + 1).alias("length"),
        F.when(F.col("start").isNotNull(), F.col("season_from") < day(cfg.fine_start)).alias("from_coarse"),
    )


def season_totals_z(seasons: DataFrame) -> DataFrame:
    """z of every season's (rounded) total across the area's seasons."""
    area = Window.partitionBy("area")
    mu, sd = F.avg("total").over(area), F.stddev_samp("total").over(area)
    return seasons.withColumn("z", F.when(sd > 0, half_even((F.col("total") - mu) / sd, 2)))


def critical_period(seasons: DataFrame, starts: DataFrame) -> DataFrame:
    """Median opening, peak and closing day of areas with at least three timed seasons."""
    med = lambda c: F.expr(f"percentile({c}, 0.5)")
    parts = ("start", "peak", "end")
    rows = (
        seasons.filter(F.col("start_off").isNotNull())
        .groupBy("area")
        .agg(F.count(F.lit(1)).alias("n"), *[F.rint(med(f"{p}_off")).cast("int").alias(f"{p}_off") for p in parts])
        .filter("n >= 3")
        .join(starts, "area")
    )
    label = lambda p: F.date_format(
        F.date_add(key_date(F.lit(2001), F.col("season_start")), F.col(f"{p}_off")), "dd MMM"
    )
    return rows.select(
        "area", *[label(p).alias(p) for p in parts], *[f"{p}_off" for p in parts],
        (F.col("end_off") - F.col("start_off") + 1).alias("length"),
    )


def top_weeks(climatology: DataFrame, cfg: Config) -> DataFrame:
    """Busiest weeks at least ``week_gap_days`` apart around the ring, ties to the earlier date.

    Greedy choice = repeat "take the best left, drop its neighbours": one window per pick, all on the
    same partitioning.
    """
    area = Window.partitionBy("area")
    doy = F.dayofyear(key_date(F.lit(2001), F.col("key")))
    left = ring_sums(climatology, cfg.smooth_days).filter("total > 0").withColumn("doy", doy)
    left = left.withColumn("alive", F.lit(True)).withColumn("rank", F.lit(None).cast("int"))
    for pick in range(1, cfg.top_weeks + 1):
        best = F.max(F.when(F.col("alive"), F.struct(F.col("total"), -F.col("i"), F.col("doy")))).over(area)
        left = left.withColumn("best", best)
        gap = F.abs(F.col("doy") - F.col("best.doy"))
        near = F.least(gap, 365 - gap) < cfg.week_gap_days
        chosen = F.col("alive") & (F.col("doy") == F.col("best.doy"))
        left = left.withColumn("rank", F.when(chosen, F.lit(pick)).otherwise(F.col("rank"))).withColumn(
            "alive", F.col("alive") & ~F.coalesce(near, F.lit(False))
        )
    return left.filter(F.col("rank").isNotNull()).select(
        "area", "rank", F.date_format(key_date(F.lit(2001), F.col("key")), "dd MMM").alias("week"),
        half_even(F.col("total"), 6).alias("total"),
    )


def latest_season(seasons_z: DataFrame) -> DataFrame:
    """Latest whole season against the mean of all (%), with its z."""
    area = Window.partitionBy("area")
    newest = area.orderBy(F.col("start_year").desc())
    mean = F.avg("total").over(area)
    return (
        seasons_z.withColumn("mean", mean)
        .withColumn("rn", F.row_number().over(newest))
        .filter("rn = 1")
        .select(
            "area", "label", "total", "z",
            half_even(F.when(F.col("mean") > 0, (F.col("total") - F.col("mean")) / F.col("mean") * 100), 3).alias(
                "vs_mean_pct"
            ),
        )
    )


def season_profile(smoothed: DataFrame, climatology: DataFrame, starts: DataFrame, seasons: DataFrame) -> DataFrame:
    """The latest whole season's smoothed days laid along the mean year, with its usual band.

    29 February has no slot; the first day that fills a slot wins, so day 366 of a 365-day season (the
    next season's first) never replaces it.
    """
    newest = seasons.groupBy("area").agg(F.max("season_from").alias("season_from"))
    days = (
        smoothed.join(newest, "area")
        .filter(F.col("d").between(F.col("season_from"), F.date_add("season_from", 365)))
        .withColumn("key", F.date_format("d", "MM-dd"))
        .filter("key <> '02-29'")
        .groupBy("area", "key")
        .agg(F.min_by("h7", "d").alias("h7"))
    )
    area = Window.partitionBy("area")
    after = F.when(F.col("key") < F.col("season_start"), 1).otherwise(0)
    slots = climatology.join(starts, "area").join(newest.select("area"), "area", "left_semi").withColumn(
        "slot", F.row_number().over(area.orderBy(after, "key")) - 1
    )
    return slots.join(days, ["area", "key"], "left").select(
        "area", "slot", "key",
        half_even(F.col("h7"), 2).alias("h7"),
        *[half_even(F.col(c), 2).alias(c) for c in ("p10", "p50", "p90")],
    )


def season_axis(starts: DataFrame, today: dt.date) -> DataFrame:
    """Day offsets of month starts inside the season year, with today's offset."""
    a = key_date(F.lit(2001), F.col("season_start"))
    this_year = key_date(F.lit(today.year), F.col("season_start"))
    began = F.when(day(today) >= this_year, this_year).otherwise(key_date(F.lit(today.year - 1), F.col("season_start")))
    month_start = F.add_months(F.trunc(a, "month"), F.col("step"))
    return (
        starts.select("area", "season_start", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("step"))
        .withColumn("off", F.datediff(month_start, a))
        .filter((F.col("off") >= 0) & (F.col("off") < 365))
        .select("area", "season_start", F.month(month_start).alias("mon"), "off", F.datediff(day(today), began).alias("today_off"))
    )
