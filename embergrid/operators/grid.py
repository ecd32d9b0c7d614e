"""Detections -> cell-days, and the tables derived from cell-days directly.

Cell-day table: area, d, yi, xi, s, n, frp. Sensor s: 0 coarse (both platforms), 1 fine, 2 coarse
platform A alone. Everything collapses detections to cell-days with map-side partial aggregation
before any shuffle, so a hot area or cell costs one row per day and sensor afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from embergrid.config import Config
from embergrid.functions.cells import cell_index, floor_div

CELL_KEYS = ["area", "d", "yi", "xi", "s"]


def bin_cells(detections: DataFrame, cfg: Config) -> DataFrame:
    return detections.withColumns(
        {"yi": cell_index(F.col("latitude"), cfg.cell), "xi": cell_index(F.col("longitude"), cfg.cell)}
    )


def _coarse_ok(cfg: Config) -> Column:
    return (F.col("instrument") == cfg.coarse_name) & (F.col("conf_pct") >= cfg.coarse_min_confidence)


def _fine_ok(cfg: Config) -> Column:
    return (F.col("instrument") == cfg.fine_name) & F.col("conf_cls").isin(*cfg.fine_classes)


def clean_archive(detections: DataFrame, cfg: Config) -> DataFrame:
    """Vegetation detections of usable confidence."""
    return detections.filter((F.col("type") == cfg.vegetation_type) & (_coarse_ok(cfg) | _fine_ok(cfg)))


def clean_live(feed: DataFrame, cfg: Config) -> DataFrame:
    return feed.filter(F.col("confidence").isin(*cfg.live_classes))


def tag_sensors(detections: DataFrame, cfg: Config) -> DataFrame:
    """One row per sensor code a clean detection counts for; platform A counts as 0 and as 2."""
    coarse = F.col("instrument") == cfg.coarse_name
    codes = F.array_compact(
        F.array(
            F.when(coarse, 0),
            F.when(F.col("instrument") == cfg.fine_name, 1),
            F.when(coarse & (F.col("satellite") == cfg.platform_a), 2),
        )
    )
    return clean_archive(detections, cfg).withColumn("s", F.explode(codes))


def grid_daily(detections: DataFrame, cfg: Config) -> DataFrame:
    """Cell-days per sensor.

    One scan and one shuffle on (area, d, yi, xi): the three sensor codes are conditional sums of the
    same group and unfold afterwards, so platform A rows are not duplicated before the exchange.
    """
    coarse = F.col("instrument") == cfg.coarse_name
    masks = {0: coarse, 1: F.col("instrument") == cfg.fine_name, 2: coarse & (F.col("satellite") == cfg.platform_a)}
    cells = bin_cells(clean_archive(detections, cfg), cfg).groupBy("area", F.col("acq_date").alias("d"), "yi", "xi")
    wide = cells.agg(
        *[F.count_if(m).alias(f"n{s}") for s, m in masks.items()],
        *[F.sum(F.when(m, F.col("frp"))).alias(f"f{s}") for s, m in masks.items()],
    )
    per_sensor = F.array(
        *[F.struct(F.lit(s).alias("s"), F.col(f"n{s}").alias("n"), F.col(f"f{s}").alias("frp")) for s in masks]
    )
    return wide.select(
        "area", "d", "yi", "xi", F.inline(F.filter(per_sensor, lambda x: x["n"] > 0))
    )


def static_cells(detections: DataFrame, cfg: Config) -> DataFrame:
    """Fine-sensor cells dominated by non-vegetation heat (no confidence rule)."""
    other = F.count_if(F.col("type") != cfg.vegetation_type)
    veg = F.count_if(F.col("type") == cfg.vegetation_type)
    fine = bin_cells(detections.filter(F.col("instrument") == cfg.fine_name), cfg)
    return (
        fine.groupBy("area", "yi", "xi")
        .agg(other.alias("other"), veg.alias("veg"))
        .filter((F.col("other") >= cfg.static_min) & (F.col("other") * F.lit(cfg.static_weight) >= F.col("veg")))
        .select("area", "yi", "xi")
    )


def all_static(static: DataFrame) -> DataFrame:
    return static.select("yi", "xi").distinct()


def mask_static(cell_days: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ("yi", "xi")) -> DataFrame:
    """Drop industrial cells. No broadcast hint: the mask grows with the record, its size decides."""
    return cell_days.join(mask.select(*keys).distinct(), list(keys), "left_anti")


def sensor_summary(grid: DataFrame) -> DataFrame:
    return grid.groupBy("s").agg(
        F.min("d").alias("first_day"),
        F.max("d").alias("last_day"),
        F.count(F.lit(1)).alias("cell_days"),
        F.sum("n").alias("detections"),
    )


def scan_grid(grid: DataFrame, areas: list | None = None, bbox: tuple | None = None, cfg: Config = Config()) -> DataFrame:
    """Rows of some areas and / or a box: literal bounds that reach the Parquet scan."""
    out = grid if areas is None else grid.filter(F.col("area").isin(*areas))
    if bbox is not None:
        y0, y1, x0, x1 = cell_bounds(bbox, cfg)
        out = out.filter(F.col("yi").between(y0, y1) & F.col("xi").between(x0, x1))
    return out


def scan_areas(grid: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows of a grid at rest (a folder per area) for the areas of a table. Their list, which the catalogue bounds, is broadcast
    and prunes the folders when the scan starts; it must come from a plan with a filter, else Spark doesn't prune."""
    return grid.join(F.broadcast(areas.select("area").distinct()), "area", "left_semi")


def cell_bounds(bbox: tuple, cfg: Config) -> tuple[int, int, int, int]:
    """Inclusive (y0, y1, x0, x1) of a box given as plain numbers."""
    import math

    w, s, e, n = bbox
    c = cfg.cell
    return math.floor(s * c), math.ceil(n * c) - 1, math.floor(w * c), math.ceil(e * c) - 1


def merge_areas(grid: DataFrame) -> DataFrame:
    """Areas overlap along borders: one row per (d, cell, s)."""
    return grid.groupBy("d", "yi", "xi", "s").agg(F.sum("n").alias("n"), F.sum("frp").alias("frp"))


def merged_daily(grid: DataFrame) -> DataFrame:
    """Daily totals over all areas, each cell-day once (plain form of ``merged_daily_fast``)."""
    return merge_areas(grid).groupBy("d", "s").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("n").alias("det"), F.sum("frp").alias("frp")
    )


def merged_daily_fast(grid: DataFrame) -> DataFrame:
    """Same totals without regrouping every row: only cells found in several areas are corrected."""
    totals = grid.groupBy("d", "s").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("n").alias("det"), F.sum("frp").alias("frp")
    )
    shared = (
        grid.groupBy("yi", "xi").agg(F.min("area").alias("lo"), F.max("area").alias("hi")).filter("lo <> hi")
    )
    surplus = (
        grid.join(shared.select("yi", "xi"), ["yi", "xi"], "left_semi")
        .groupBy("d", "s", "yi", "xi")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("d", "s")
        .agg(F.sum(1 - F.col("copies")).alias("cells"), F.lit(0).cast("bigint").alias("det"), F.lit(0.0).alias("frp"))
    )
    return totals.unionByName(surplus).groupBy("d", "s").agg(
        F.sum("cells").alias("cells"), F.sum("det").alias("det"), F.sum("frp").alias("frp")
    )


def strip_reclass(grid: DataFrame, strips: DataFrame, cfg: Config) -> DataFrame:
    """Inside a lost-orbit strip coarse becomes 4 (stands in) and fine 3 (partial, to be dropped).

    ``strips`` holds at most one row per day and longitude band; its size, written before, decides how it is joined.
    """
    lost = strips.select("d", F.col("band").alias("_band"), F.lit(True).alias("_lost"))
    return (
        grid.withColumn("_band", floor_div(F.col("xi"), cfg.strip_cells))
        .join(lost, ["d", "_band"], "left")
        .withColumn("s", F.when((F.col("s") < 2) & F.col("_lost"), 4 - F.col("s")).otherwise(F.col("s")))
        .drop("_band", "_lost")
    )


def daily_totals(grid: DataFrame, keys: tuple[str, ...] = ("area",)) -> DataFrame:
    """Wide daily counts per area: m (coarse), v (fine), t (platform A), mg (coarse inside strips)."""
    s = F.col("s")
    groups = {"m": s.isin(0, 4), "v": s == 1, "t": s == 2}
    aggs = []
    for name, is_it in groups.items():
        aggs += [
            F.count_if(is_it).cast("double").alias(name),
            F.coalesce(F.sum(F.when(is_it, F.col("n"))), F.lit(0)).cast("double").alias(f"{name}_det"),
            F.coalesce(F.sum(F.when(is_it, F.col("frp"))), F.lit(0.0)).alias(f"{name}_frp"),
        ]
    return grid.groupBy(*keys, "d").agg(*aggs, F.count_if(s == 4).cast("double").alias("mg"))


def distinct_cells(grid: DataFrame) -> DataFrame:
    return grid.select("area", "yi", "xi").distinct()


def recorded_cells(detections: DataFrame, cfg: Config) -> DataFrame:
    """``distinct_cells`` straight from detections, when no cell-day table is at hand."""
    return bin_cells(clean_archive(detections, cfg), cfg).select("area", "yi", "xi").distinct()


def data_extent(grid: DataFrame, cfg: Config) -> DataFrame:
    """Extent in degrees and last day of every area that has records."""
    c = float(cfg.cell)
    return grid.groupBy("area").agg(
        (F.min("xi") / c).alias("w"),
        (F.min("yi") / c).alias("s"),
        ((F.max("xi") + 1) / c).alias("e"),
        ((F.max("yi") + 1) / c).alias("n"),
        F.max("d").alias("last_day"),
    )


def main_side_extent(grid: DataFrame, cfg: Config) -> DataFrame:
    """For areas wider than ``wide_span_deg``: extent of the hemisphere with most distinct cells."""
    c = float(cfg.cell)
    sides = (
        distinct_cells(grid)
        .groupBy("area", (F.col("xi") >= 0).alias("east"))
        .agg(
            F.count(F.lit(1)).alias("cells"),
            F.min("xi").alias("x0"),
            F.min("yi").alias("y0"),
            F.max("xi").alias("x1"),
            F.max("yi").alias("y1"),
        )
    )
    whole = Window.partitionBy("area")
    best = whole.orderBy(F.col("cells").desc(), F.col("east"))
    return (
        sides.withColumn("span", F.max("x1").over(whole) - F.min("x0").over(whole))
        .withColumn("rn", F.row_number().over(best))
        .filter((F.col("rn") == 1) & (F.col("span") / c > cfg.wide_span_deg))
        .select(
            "area", "east", "cells",
            (F.col("x0") / c).alias("w"), (F.col("y0") / c).alias("s"),
            ((F.col("x1") + 1) / c).alias("e"), ((F.col("y1") + 1) / c).alias("n"),
        )
    )


def build_record(detections: DataFrame, cfg: Config, archive_year: int | None = None) -> DataFrame:
    """Last archive year of every area: the published year, else the last year both sensors reached."""
    last = lambda name: F.max(F.when(F.col("instrument") == name, F.year("acq_date")))
    out = detections.groupBy("area").agg(last(cfg.coarse_name).alias("c"), last(cfg.fine_name).alias("f"))
    # least() skips NULLs, as the last year of the only sensor present
    return out.select("area", F.coalesce(F.lit(archive_year).cast("int"), F.least("c", "f")).alias("archive_through"))


def record_end(records: DataFrame) -> DataFrame:
    """One record end for all areas: the earliest year any area is complete through."""
    return records.agg(F.min("archive_through").alias("year")).select(
        "year", F.make_date(F.col("year"), F.lit(12), F.lit(31)).alias("record_end")
    )


def last_full_year(detections: DataFrame, cfg: Config) -> DataFrame:
    """(year): the last year that both sensors cover to its end, by the last day of the one that stops first.

    A year that stops early is left out whole: a missing month must not read as a month without fire. NULL without
    detections of both sensors.
    """
    last = lambda name: F.max(F.when(F.col("instrument") == name, F.col("acq_date")))
    ends = detections.agg(last(cfg.coarse_name).alias("c"), last(cfg.fine_name).alias("f"))
    end = F.when(F.col("c") < F.col("f"), F.col("c")).otherwise(F.when(F.col("c").isNotNull(), F.col("f")))
    return ends.select((F.year(F.date_add(end, 1)) - 1).alias("year"))
