"""Queries about sources and sinks: write derived tables in a source's format, read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from embergrid.operators import calendar, documents, geo, grid, outages, seasons, tiles, validate
from embergrid.plans import adapters
from embergrid.plans.workspace import Workspace
from embergrid.session import scratch_path
from embergrid.sources import archives, borders, gazetteer, grids, packs, prior, versions

DIGITS, LETTERS = "0123456789", "abcdefghij"

NAME_MATCH_SQL = """
WITH named AS (SELECT n_nationkey AS k, translate(n_name, '0123456789', 'abcdefghij') AS name FROM nation),
feature AS (
  SELECT k, 1 AS priority, 'NÁTÎON ' || right(name, length(name) - 7) AS v FROM named WHERE k % 3 = 0
  UNION ALL SELECT k, 2, 'Nátîon ' || right(name, length(name) - 7) FROM named WHERE k % 3 <> 2
  UNION ALL SELECT k, 3, name FROM named WHERE k % 5 <> 4),
known AS (SELECT regexp_replace(lower(strip_accents(v)), '[^a-z]', '', 'g') AS key, priority, k FROM feature
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority, k) = 1),
wanted AS (SELECT k AS area, regexp_replace(lower(CASE WHEN k % 7 = 6
    THEN 'nation ' || translate(CAST(k - 1 AS VARCHAR), '0123456789', 'abcdefghij') ELSE name END), '[^a-z]', '', 'g') AS key FROM named)
SELECT w.area, n.k AS feature_id, n.priority FROM wanted w LEFT JOIN known n ON n.key = w.key
"""


def match_names(w: Workspace) -> DataFrame:
    spelled = lambda df, *cols: df.withColumns({c: F.translate(c, DIGITS, LETTERS) for c in cols})
    columns = ("admin", "name_long", "short_name")
    return geo.name_match(
        spelled(w.catalogue, "name"),
        spelled(adapters.features(w.spark, w.dir), *columns),
        columns,
        spelled(adapters.aliases(w.spark, w.dir), "alias"),
    )


def provenance(w: Workspace) -> DataFrame:
    """Write the grid as one folder per area, scan it again and tell each row's area from its file."""
    path = scratch_path(w.spark, "grid")
    grids.write_grid(w.grid_lazy, path)
    return grids.scan_with_provenance(w.spark, path).groupBy("area").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("detections")
    )


def read_borders(w: Workspace) -> DataFrame:
    path = scratch_path(w.spark, "borders")
    key = F.col("n_nationkey").cast("bigint")
    cx, cy = (key % 5) * 1500 - 3000, F.floor(key / 5) * 1500 - 3000

    def ring(radius: int):
        corners = [(radius, 0), (0, radius), (-radius, 0), (0, -radius), (radius, 0)]
        return F.array(*[F.array((cx + x) / 10000, (cy + y) / 10000) for x, y in corners])

    rings = F.when(F.col("n_nationkey") % 2 == 0, F.array(ring(1600), ring(400))).otherwise(F.array(ring(1600)))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("n_nationkey").alias("id")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"),
    )
    adapters.read(w.spark, w.dir, "nation").filter("n_nationkey % 5 <> 4").select(F.to_json(feature)).write.text(path)
    return borders.read_borders(w.spark, path).withColumn("area", F.col("area").cast("int"))


def read_places(w: Workspace) -> DataFrame:
    base = scratch_path(w.spark, "places")
    empty = lambda n: [F.lit("").alias(f"e{n}")]
    cc = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    towns = w.places.join(
        adapters.read(w.spark, w.dir, "supplier").select(F.col("s_suppkey").alias("place_id"), "s_nationkey"), "place_id"
    )
    towns.select(
        "place_id", "name", *empty(2), *empty(3), "lat", "lon", *empty(6), *empty(7), cc.alias("cc"), *empty(9),
        F.lit("01").alias("admin"), *empty(11), *empty(12), *empty(13), F.col("pop").cast("bigint"),
    ).write.option("sep", "\t").option("emptyValue", "").csv(f"{base}/towns")
    nation = adapters.read(w.spark, w.dir, "nation")
    code = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    nation.select(F.concat(code, F.lit(".01")), "n_name").write.option("sep", "\t").csv(f"{base}/regions")
    nation.select(code, *[F.lit("-").alias(f"c{i}") for i in range(3)], "n_name").write.option("sep", "\t").csv(f"{base}/countries")
    read = gazetteer.read_places(w.spark, f"{base}/towns", f"{base}/regions", f"{base}/countries")
    return read.select("place_id", "name", "lat", "lon", "region", "pop")


def packed_tiles(w: Workspace) -> DataFrame:
    path = scratch_path(w.spark, "tiles")
    packs.write_packed_tiles(tiles.tile_delta_encode(w.grid_lazy, w.cfg), path)
    return packs.read_packed_tiles(w.spark, path).select("ty", "tx", "s", "y", F.col("n").cast("bigint").alias("entries"))


def analysis_documents(w: Workspace) -> DataFrame:
    return documents.analysis_document(
        w.areas, w.smoothed, w.anomalies, w.unusual, w.climatology, w.starts, seasons.season_totals_z(w.timing),
        seasons.critical_period(w.timing, w.starts), seasons.top_weeks(w.climatology, w.cfg),
        calendar.yearly_totals(w.series, w.cfg), validate.reliability(w.r2, w.cv_median, w.cfg),
    )


def _archive(w: Workspace, instrument: str, columns: dict[str, str]) -> str:
    """Write the detections of one instrument as yearly CSV files, a folder per area; gives the file pattern."""
    base = scratch_path(w.spark, f"archive_{instrument}")
    rows = w.detections.filter(F.col("instrument") == instrument)
    named = rows.select("area", F.year("acq_date").alias("y"), *[F.col(c).alias(name) for name, c in columns.items()])
    for year in sorted(r["y"] for r in named.select("y").distinct().collect()):  # calendar years
        named.filter(F.col("y") == year).drop("y").write.mode("append").partitionBy("area").option("header", True).csv(f"{base}")
    return f"{base}/*/*.csv"


def coarse_archive(w: Workspace) -> DataFrame:
    names = {"longitude": "longitude", "latitude": "latitude", "acq_date": "acq_date", "satellite": "satellite", "confidence": "conf_pct", "frp": "frp", "type": "type"}
    rows = archives.read_coarse_archive(w.spark, [_archive(w, w.base.coarse_name, names)])
    return _by_archive_area(rows, F.sum("confidence").cast("bigint").alias("confidence"), F.count_if(F.col("satellite") == w.base.platform_a).alias("platform_a"))


def fine_archive(w: Workspace) -> DataFrame:
    names = {"latitude": "latitude", "longitude": "longitude", "acq_date": "acq_date", "confidence": "conf_cls", "frp": "frp", "type": "type"}
    rows = archives.read_fine_archive(w.spark, [_archive(w, w.base.fine_name, names)])
    return _by_archive_area(rows, F.count_if(F.col("confidence") == "h").alias("high"), F.max("acq_date").alias("last_day"))


def _by_archive_area(rows: DataFrame, *aggregates) -> DataFrame:
    area = F.regexp_extract("area", r"(\d+)$", 1).cast("int").alias("area")  # the folder is called area=<id>
    return rows.groupBy(area).agg(F.count(F.lit(1)).alias("rows"), *aggregates)


def live_feed(w: Workspace) -> DataFrame:
    path = scratch_path(w.spark, "feed")
    w.feed.select("latitude", "longitude", "acq_date", F.lpad(F.col("hhmm").cast("string"), 4, "0").alias("acq_time"), "confidence", "frp").write.option(
        "header", True
    ).csv(path)
    rows = archives.read_live_feed(w.spark, path)
    return rows.groupBy("acq_date", "confidence").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("hhmm").cast("int")).alias("latest"))


def _prior_file(w: Workspace) -> str:
    path = scratch_path(w.spark, "prior")
    prior.write_prior(outages.pooled_prior(w.bands, w.outages, w.strips, w.base), w.outages, w.strips, path, w.base)
    return path


def loaded_prior(w: Workspace) -> DataFrame:
    """Ratios of the published document, as a configuration holds them."""
    cfg = prior.load_prior(w.spark, _prior_file(w), w.base)
    return w.spark.range(1).select(F.lit(cfg.prior_k).alias("k"), F.lit(cfg.prior_kt).alias("kt"), F.lit(cfg.strip_deg).alias("strip_deg"))


def loaded_outages(w: Workspace) -> DataFrame:
    calendar_, strips = prior.load_outages(w.spark, _prior_file(w), w.base)
    days = calendar_.select("d", F.lit(None).cast("int").alias("band"), "fine_out", "coarse_out", "b_out", "unknown")
    none = [F.lit(None).cast("boolean").alias(c) for c in ("fine_out", "coarse_out", "b_out", "unknown")]
    return days.unionByName(strips.select("d", "band", *none))


def scanned_grid(w: Workspace, areas: list[int], box: tuple) -> DataFrame:
    """A scan of the grid at rest: folders of other areas are not opened, the box's cell range reaches the files."""
    path = scratch_path(w.spark, "grid")
    grids.write_grid(w.grid_lazy, path)
    rows = grid.scan_grid(grids.read_grid(w.spark, path), areas, box, w.base)
    wide = {"yi": "int", "xi": "int", "s": "int", "n": "bigint", "frp": "double"}
    return rows.select("area", "d", *[F.col(c).cast(t).alias(c) for c, t in wide.items()])


def written_grid(w: Workspace) -> DataFrame:
    """The grid written at rest and read again."""
    path = scratch_path(w.spark, "grid")
    grids.write_grid(w.grid_lazy, path)
    rows = grids.read_grid(w.spark, path)
    return rows.groupBy("area", "s").agg(F.count(F.lit(1)).alias("cell_days"), F.sum("n").alias("detections"), F.min("d").alias("first_day"))


def _updated(w: Workspace) -> str:
    """A grid at rest built up to the year before the last one and then updated with all years."""
    path = scratch_path(w.spark, "grid_versions")
    versions.update_grid(w.grid.filter(F.year("d") < w.full_year), path)
    versions.update_grid(w.grid, path)
    return path


def updated_grid(w: Workspace) -> DataFrame:
    rows = versions.read_version(w.spark, _updated(w))
    return rows.groupBy("area", F.col("s").cast("int").alias("s")).agg(F.count(F.lit(1)).alias("cell_days"), F.sum("n").alias("detections"), F.min("d").alias("first_day"))


def updated_manifest(w: Workspace) -> DataFrame:
    return versions.grid_manifest(w.spark, _updated(w)).drop("digest")


def map_layers(w: Workspace) -> DataFrame:
    path = scratch_path(w.spark, "layers")
    packs.write_map_layers(w.published, path, w.cfg)
    tiles_ = w.spark.read.schema("layer string, ty int, tx int, xi int, yi int, val double").json(f"{path}/tiles")
    counted = tiles_.groupBy("layer", "ty", "tx").agg(F.count(F.lit(1)).alias("in_tile"))
    index = w.spark.read.schema("layer string, ty int, tx int, cells bigint, max_value double").json(f"{path}/index")
    return index.join(counted, ["layer", "ty", "tx"], "left")


def live_outputs(w: Workspace) -> DataFrame:
    path = scratch_path(w.spark, "live_outputs")
    packs.write_live_outputs(w.live_masked, w.feed, w.links(w.live_masked), w.static, path, w.base)
    index = w.spark.read.schema("ty int, tx int, cells bigint").json(f"{path}/index")
    overview = w.spark.read.schema("f int, bx int, by int, val double").json(f"{path}/overview")
    part = lambda df, name, total: df.agg(F.count(F.lit(1)).alias("rows"), F.sum(total).cast("double").alias("total")).withColumn("part", F.lit(name))
    return part(index, "index", "cells").unionByName(part(overview, "overview", "val"))


def live_overview(w: Workspace) -> DataFrame:
    """The overview of the published live files, at most 20 squares, with its scale and the number of the feed's days."""
    path = scratch_path(w.spark, "live_outputs")
    packs.write_live_outputs(w.live_masked, w.feed, w.links(w.live_masked), w.static, path, w.base.with_(live_cells=20))
    shown = w.spark.read.schema("f int, cell double, max double, bx int, by int, val double").json(f"{path}/overview")
    meta = w.spark.read.schema("days array<date>").json(f"{path}/meta").select(F.size("days").cast("bigint").alias("days"))
    return shown.join(F.broadcast(meta), F.col("f") > 0)  # one row
