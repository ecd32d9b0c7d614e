"""The live feed: a rolling window of detections whose first and last calendar day are partial.

Live cell-days: d, yi, xi, n, frp. They are bounded by the feed's days and the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from embergrid.config import Config
from embergrid.functions.cells import in_tile
from embergrid.functions.numbers import half_even, settled
from embergrid.operators.grid import bin_cells, clean_live



def _all_days() -> WindowSpec:
    """One window over all rows: only ever used on distinct days."""
    return Window.partitionBy(F.lit(1))


def live_cell_days(feed: DataFrame, cfg: Config) -> DataFrame:
    return (
        bin_cells(clean_live(feed, cfg), cfg)
        .groupBy(F.col("acq_date").cast("date").alias("d"), "yi", "xi")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("frp").alias("frp"))
    )


def live_latest(feed: DataFrame) -> DataFrame:
    """Newest detection "yyyy-MM-dd HHMM" over all rows, also those of low confidence."""
    stamp = F.concat_ws(" ", F.col("acq_date").cast("string"), F.lpad(F.col("hhmm").cast("string"), 4, "0"))
    return feed.agg(F.max(stamp).alias("latest"))


def feed_days(cell_days: DataFrame) -> DataFrame:
    """(d, first, last): distinct days of the feed and its edges (a handful of rows)."""
    days = cell_days.select("d").distinct()
    return days.withColumns({"first": F.min("d").over(_all_days()), "last": F.max("d").over(_all_days())})


def complete_days(cell_days: DataFrame) -> DataFrame:
    """Days with live fires strictly between the feed's edges."""
    return feed_days(cell_days).filter("d > first and d < last").select("d")


def window_days(cell_days: DataFrame) -> DataFrame:
    """Every calendar day strictly between the feed's edges, with or without fires."""
    edges = cell_days.agg(F.date_add(F.min("d"), 1).alias("a"), F.date_sub(F.max("d"), 1).alias("b"))
    return edges.filter("a <= b").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d"))


def live_map(masked: DataFrame) -> DataFrame:
    return masked.groupBy("xi", "yi").agg(F.sum("n").cast("double").alias("val"))


def live_meta(masked: DataFrame, feed: DataFrame) -> DataFrame:
    """One row: days, complete days, detections, newest detection (arrays hold the feed's days only)."""
    days = masked.groupBy("d").agg(F.sum("n").alias("n")).agg(
        F.array_sort(F.collect_list("d")).alias("days"), F.sum("n").alias("detections")
    )
    inner = F.when(F.size("days") > 2, F.slice("days", 2, F.size("days") - 2)).otherwise(F.array().cast("array<date>"))
    both = days.withColumn("one", F.lit(1)).join(live_latest(feed).withColumn("one", F.lit(1)), "one")
    return both.select("days", inner.alias("complete_days"), "detections", "latest")


def live_area_counts(masked: DataFrame, links: DataFrame) -> DataFrame:
    """(area, d, cells, frp): cell-days per area and complete day, 0-filled; frp is the area's total."""
    days = complete_days(masked)
    hits = masked.join(F.broadcast(days), "d", "left_semi").join(links, ["yi", "xi"])
    per_day = hits.groupBy("area", "d").agg(F.count(F.lit(1)).alias("cells"), F.sum("frp").alias("frp"))
    # one map entry per day of the feed
    per_area = per_day.groupBy("area").agg(
        F.map_from_entries(F.collect_list(F.struct("d", "cells"))).alias("on"), F.sum("frp").alias("total_frp")
    )
    listed = days.agg(F.collect_list("d").alias("ds"))
    spine = per_area.join(F.broadcast(listed), F.size("ds") > 0).withColumn("d", F.explode("ds"))
    return spine.select(
        "area", "d", F.coalesce(F.try_element_at("on", F.col("d")), F.lit(0)).cast("bigint").alias("cells"),
        settled(F.col("total_frp"), 0).alias("frp"),
    )


def live_tiles(cell_days: DataFrame, cfg: Config) -> DataFrame:
    """(ty, tx, days, rows): a tile's feed days and rows (day index, xi, yi, n).

    A tile holds at most its cells times the feed's days.
    """
    ty, tx, _ = in_tile(F.col("yi"), F.col("xi"), cfg.map_tile)
    days = cell_days.select("d").distinct().agg(F.array_sort(F.collect_list("d")).alias("days"))
    rows = cell_days.join(F.broadcast(days), F.size("days") > 0).withColumn("di", F.array_position("days", F.col("d")) - 1)
    row = F.struct(F.col("di").cast("int").alias("di"), "xi", "yi", "n")
    return rows.groupBy(ty.alias("ty"), tx.alias("tx")).agg(
        F.first("days").alias("days"), F.sort_array(F.collect_list(row)).alias("rows")
    )


def rebuild_from_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles -> live cell-days."""
    return tiles.select("days", F.inline("rows")).select(F.get("days", F.col("di")).alias("d"), "yi", "xi", "n")


def join_feeds(site: DataFrame, fresh: DataFrame, cfg: Config) -> DataFrame:
    """Older copy up to and including the fresh feed's first (partial) day, the fresh feed afterwards.

    Keeps the last ``live_days`` days. Empty unless the copy has some day after that first one (only
    then is its copy of that day complete).
    """
    first = fresh.agg(F.min("d").alias("cut"))
    newest = site.agg(F.max("d").alias("newest"))
    cut = first.join(F.broadcast(newest), F.col("newest") > F.col("cut")).select("cut")  # one row or none
    cut = F.broadcast(cut)
    old = site.join(cut, F.col("d") <= F.col("cut")).drop("cut")
    new = fresh.join(cut, F.col("d") > F.col("cut")).drop("cut")
    both = old.unionByName(new)
    last_days = (
        both.select("d").distinct()
        .withColumn("rn", F.row_number().over(_all_days().orderBy(F.col("d").desc())))
        .filter(F.col("rn") <= cfg.live_days)
        .select("d")
    )
    return both.join(F.broadcast(last_days), "d", "left_semi")


# ---- early warning: this window against the same dates of every past year ----


def nowcast_now(cell_days: DataFrame, links: DataFrame, static: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, d, cells, total, frp): cell-days per area and calendar day of the window, 0-filled.

    An area's own industrial cells are masked.
    """
    days = window_days(cell_days)
    inside = (
        cell_days.join(F.broadcast(days), "d", "left_semi")
        .join(links, ["yi", "xi"])
        .join(static.select("area", "yi", "xi"), ["area", "yi", "xi"], "left_anti")
    )
    per_day = inside.groupBy("area", "d").agg(F.count(F.lit(1)).alias("cells"), F.sum("frp").alias("frp"))
    return over_window(per_day, days, areas)


def over_window(per_day: DataFrame, days: DataFrame, areas: DataFrame) -> DataFrame:
    """Counts (area, d, cells, frp) 0-filled over the window's ``days`` for every area, with its totals."""
    listed = days.agg(F.collect_list("d").alias("ds"))
    spine = areas.select("area").join(F.broadcast(listed), F.size("ds") > 0).select("area", F.explode("ds").alias("d"))
    filled = spine.join(per_day, ["area", "d"], "left").na.fill(0, ["cells"]).na.fill(0.0, ["frp"])
    area = Window.partitionBy("area")
    return filled.select(
        "area", "d", "cells", F.sum("cells").over(area).alias("total"),
        settled(F.sum("frp").over(area), 0).alias("frp"),
    )


def nowcast_history(cell_days: DataFrame, series: DataFrame, cfg: Config) -> DataFrame:
    """(area, y, total): the same dates, equally long, in every past complete year.

    The past windows are at most years x feed days, so they are broadcast to the daily series.
    """
    from embergrid.functions.dates import day, same_date_in

    window = window_days(cell_days).agg(F.min("d").alias("a"), F.count(F.lit(1)).cast("int").alias("len"))
    years = window.filter("len > 0").withColumn("y", F.explode(F.sequence(F.lit(cfg.first_full), F.lit(cfg.last_full))))
    start = same_date_in(F.col("y"), F.month("a"), F.dayofmonth("a"))
    past = (
        years.withColumn("from", start)
        .withColumn("to", F.expr("date_add(`from`, len - 1)"))
        .filter(F.col("to") <= day(cfg.record_end))
        .select("y", F.explode(F.sequence("from", "to", F.expr("interval 1 day"))).alias("d"))
    )
    return series.join(F.broadcast(past), "d").groupBy("area", "y").agg(F.sum("h").alias("total"))


def nowcast_rank(now: DataFrame, history: DataFrame, cfg: Config) -> DataFrame:
    """Where this window stands among past years (ties count half)."""
    from embergrid.functions.labels import now_status

    current = now.groupBy("area").agg(F.max("total").alias("now"))
    h = F.col("total")
    both = history.join(current, "area")
    pct = F.avg((h < F.col("now")).cast("double")) * 100 + F.avg((h == F.col("now")).cast("double")) * 50
    q = F.expr("percentile(total, array(0.1, 0.5, 0.9))")
    ranked = both.groupBy("area", "now").agg(
        q.alias("q"), F.max(h).alias("hi"), half_even(pct, 0).alias("percentile"), F.count(F.lit(1)).alias("n_years")
    )
    return ranked.select(
        "area", "now",
        *[half_even(F.col("q")[i], 1).alias(c) for i, c in enumerate(("p10", "p50", "p90"))],
        half_even(F.col("hi"), 1).alias("max"), "percentile", "n_years",
        (F.col("now") > F.col("hi")).alias("record"),
    ).withColumn("status", now_status(F.col("record"), F.col("percentile"), cfg))
