"""Shared derived tables of one record, each built once, on first use.

The grid, the daily series, the ratios and the harmonized series feed many results; they are written to
the cluster's shared folder and read back (see ``session.materialize``), so nothing downstream
recomputes them and lost executors cost nothing but a re-read.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from embergrid.config import Config
from embergrid.operators import calendar, geo, grid, harmonize, layers, live, outages, seasons, validate
from embergrid.plans import adapters
from embergrid.session import materialize, scratch_path, utc
from embergrid.sources import grids


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str, cfg: Config = adapters.TABLE_CONFIG):
        self.spark, self.dir, self.base = utc(spark), sf_dir, cfg

    @cached_property
    def full_year(self) -> int:
        """Last year that both sensors cover to its end: the published year of the record."""
        year = grid.last_full_year(self.detections, self.base).first()["year"]
        return self.base.record_end.year if year is None else year

    @cached_property
    def cfg(self) -> Config:
        """The configuration with the record's own end."""
        return self.base.with_(record_end=dt.date(self.full_year, 12, 31))

    @cached_property
    def today(self) -> dt.date:
        """The day of the feed's newest event."""
        return adapters.newest(self.spark, self.dir).first()["newest"].date()

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, label)

    # ---- inputs
    @cached_property
    def detections(self) -> DataFrame:
        return adapters.detections(self.spark, self.dir, self.base)

    @cached_property
    def catalogue(self) -> DataFrame:
        return adapters.catalogue(self.spark, self.dir)

    @cached_property
    def areas(self) -> DataFrame:
        return self.catalogue.select("area")

    @cached_property
    def feed(self) -> DataFrame:
        return adapters.live(self.spark, self.dir)

    @cached_property
    def edges(self) -> DataFrame:
        return adapters.border_edges(self.spark, self.dir)

    @cached_property
    def boxes(self) -> DataFrame:
        return adapters.boxes(self.spark, self.dir)

    @cached_property
    def places(self) -> DataFrame:
        return adapters.places(self.spark, self.dir)

    # ---- grid and outages
    @cached_property
    def grid_lazy(self) -> DataFrame:
        return grid.grid_daily(self.detections, self.base)

    @cached_property
    def grid(self) -> DataFrame:
        return self._keep(self.grid_lazy, "grid")

    @cached_property
    def grid_at_rest(self) -> DataFrame:
        """The grid as it is published: a folder per area, rows in order."""
        path = scratch_path(self.spark, "grid_at_rest")
        grids.write_grid(self.grid, path)
        wide = {"yi": "int", "xi": "int", "s": "int", "n": "bigint", "frp": "double"}
        return grids.read_grid(self.spark, path).select("area", "d", *[F.col(c).cast(t).alias(c) for c, t in wide.items()])

    @cached_property
    def static(self) -> DataFrame:
        return grid.static_cells(self.detections, self.base)

    @cached_property
    def bands(self) -> DataFrame:
        return self._keep(outages.band_counts(self.grid, self.base), "bands")

    @cached_property
    def world(self) -> DataFrame:
        return outages.world_daily(self.bands)

    @cached_property
    def gaps(self) -> DataFrame:
        return self.outages.filter("fine_out").select("d")

    @cached_property
    def strips(self) -> DataFrame:
        return self._keep(outages.fine_strips(self.bands, self.gaps, self.base), "strips")

    @cached_property
    def outages(self) -> DataFrame:
        return self._keep(outages.outage_calendar(self.world, self.base), "outages")

    # ---- harmonized series
    @cached_property
    def reclassed(self) -> DataFrame:
        return grid.strip_reclass(self.grid, self.strips, self.base)

    @cached_property
    def daily_lazy(self) -> DataFrame:
        return harmonize.date_spine_join(grid.daily_totals(self.reclassed), self.areas, self.outages, self.cfg)

    @cached_property
    def flagged(self) -> DataFrame:
        return self._keep(harmonize.flag_days(self.daily_lazy, self.cfg), "daily")

    @cached_property
    def monthly(self) -> DataFrame:
        return harmonize.monthly_sums(self.flagged, self.cfg)

    @cached_property
    def ratios(self) -> DataFrame:
        return self._keep(harmonize.fit_ratios(self.monthly, self.areas, self.cfg), "ratios")

    @cached_property
    def series_lazy(self) -> DataFrame:
        return harmonize.fill_no_record(harmonize.harmonize_daily(self.flagged, self.ratios, self.cfg))

    @cached_property
    def series(self) -> DataFrame:
        """Harmonized days with their smoothed value: both windows cluster on area, one shuffle."""
        return self._keep(calendar.centered_mean(self.series_lazy, self.cfg), "series")

    @cached_property
    def no_record_scale(self) -> DataFrame:
        return self._keep(harmonize.no_record_scale(self.series), "scale")

    # ---- calendar
    @cached_property
    def smoothed(self) -> DataFrame:
        return self.series

    @cached_property
    def months(self) -> DataFrame:
        return calendar.month_totals(self.series)

    @cached_property
    def normals(self) -> DataFrame:
        return calendar.month_normals(self.months, self.cfg)

    @cached_property
    def anomalies(self) -> DataFrame:
        return calendar.month_anomaly(self.months, self.normals)

    @cached_property
    def unusual(self) -> DataFrame:
        return calendar.unusual_months(self.anomalies, self.normals, self.cfg)

    @cached_property
    def climatology(self) -> DataFrame:
        return self._keep(calendar.doy_climatology(self.smoothed, self.cfg), "climatology")

    @cached_property
    def starts(self) -> DataFrame:
        return self._keep(seasons.season_start(self.climatology, self.areas, self.cfg), "starts")

    @cached_property
    def assigned(self) -> DataFrame:
        return seasons.season_assign(self.smoothed, self.starts, self.cfg)

    @cached_property
    def timing(self) -> DataFrame:
        return self._keep(seasons.season_timing(self.assigned, self.cfg), "seasons")

    # ---- validation
    @cached_property
    def r2(self) -> DataFrame:
        return validate.monthly_r2(self.monthly, self.ratios, self.areas)

    @cached_property
    def cv_median(self) -> DataFrame:
        return validate.cv_median_ape(validate.cross_validate(self.monthly, self.cfg), self.areas)

    # ---- layers
    @cached_property
    def cell_months(self) -> DataFrame:
        months = layers.cell_months(self.grid, self.outages, self.strips, self.ratios, self.no_record_scale, self.cfg)
        return self._keep(months, "cell_months")

    @cached_property
    def layer_years(self) -> DataFrame:
        return layers.layer_years(self.flagged)

    @cached_property
    def area_layers(self) -> DataFrame:
        return layers.area_layers(self.cell_months, self.layer_years)

    @cached_property
    def published_lazy(self) -> DataFrame:
        return layers.published_layers(self.cell_months, self.layer_years, self.cfg)

    @cached_property
    def published(self) -> DataFrame:
        """Kept for operators that read the layers several times."""
        return self._keep(self.published_lazy, "layers")

    # ---- live
    @cached_property
    def live(self) -> DataFrame:
        return live.live_cell_days(self.feed, self.base)

    @cached_property
    def live_kept(self) -> DataFrame:
        return self._keep(self.live, "live")

    @cached_property
    def live_masked(self) -> DataFrame:
        return self._keep(grid.mask_static(self.live, self.static), "masked")

    @cached_property
    def own_cells(self) -> DataFrame:
        """Cells of each area's record; from the grid if it has been built."""
        known = self.__dict__.get("grid")
        return self._keep(grid.recorded_cells(self.detections, self.base) if known is None else grid.distinct_cells(known), "own")

    @cached_property
    def spans(self) -> DataFrame:
        """The areas row by row: they change with the borders only."""
        return self._keep(geo.area_spans(self.edges, self.base), "spans")

    def links(self, cell_days: DataFrame) -> DataFrame:
        return geo.cell_area_link(geo.cells_in_spans(cell_days, self.spans), self.own_cells, cell_days)
