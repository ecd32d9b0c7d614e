"""Sinks of published results: packed tiles, map layers, live files, daily CSV, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embergrid.config import Config
from embergrid.operators import layers, live


def write_packed_tiles(packs: DataFrame, path: str) -> None:
    packs.repartitionByRange("ty", "tx", "s", "y").write.partitionBy("ty").option("compression", "zstd").parquet(path)


def read_packed_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_map_layers(published: DataFrame, path: str, cfg: Config) -> None:
    """Per layer: 10-degree tiles at full detail, the overview, and an index with tile sizes and scale."""
    tiled = layers.map_tiles(published, cfg)
    tiled.repartitionByRange("layer", "ty", "tx").write.partitionBy("layer", "ty", "tx").json(f"{path}/tiles")
    layers.overview(published, cfg).write.partitionBy("layer").json(f"{path}/overview")
    index = layers.tile_index(published, cfg.map_tile, "layer").join(layers.layer_scale(published).drop("cells"), "layer")
    index.write.json(f"{path}/index")


def write_live_outputs(masked: DataFrame, feed: DataFrame, links: DataFrame, mask: DataFrame, path: str, cfg: Config) -> None:
    """Overview with its scale, tiles with their index, counts per area, meta and the industrial mask of a live feed."""
    layers.coarsened_map(live.live_map(masked), cfg.live_cells, cfg, "sum").write.json(f"{path}/overview")
    live.live_tiles(masked, cfg).write.partitionBy("ty", "tx").json(f"{path}/tiles")
    layers.tile_index(masked, cfg.map_tile).write.json(f"{path}/index")
    live.live_area_counts(masked, links).write.json(f"{path}/areas")
    live.live_meta(masked, feed).write.json(f"{path}/meta")
    mask.select("yi", "xi").distinct().write.json(f"{path}/static_cells")


def write_daily_csv(export: DataFrame, path: str) -> None:
    """One folder per area, header line, days in order; NULL (no record) stays empty."""
    (
        export.repartitionByRange("area", "d")
        .sortWithinPartitions("area", "d")
        .write.partitionBy("area")
        .option("header", True)
        .csv(path)
    )


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.partitionBy("area").text(path)
