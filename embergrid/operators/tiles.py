"""Packed cell-day tiles: per tile, sensor and year, day steps and in-tile places in day order.

A pack covers one year, so it holds at most tile*tile*366 entries however long or dense the record;
a day step counts from the previous entry, the first one from 1 January.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from embergrid.config import Config
from embergrid.functions.cells import in_tile


def tile_keys(grid: DataFrame, cfg: Config) -> DataFrame:
    ty, tx, idx = in_tile(F.col("yi"), F.col("xi"), cfg.box_tile)
    return grid.select("d", "yi", "xi", "s", ty.alias("ty"), tx.alias("tx"), idx.alias("idx")).distinct()


def tile_delta_encode(grid: DataFrame, cfg: Config) -> DataFrame:
    """(ty, tx, s, y, n, steps, places) over the distinct cell-days of all areas."""
    entry = F.struct((F.dayofyear("d") - 1).alias("day"), F.col("idx"))
    packs = (
        tile_keys(grid, cfg)
        .groupBy("ty", "tx", "s", F.year("d").alias("y"))
        .agg(F.sort_array(F.collect_list(entry)).alias("e"))
    )
    # the list against itself one entry later: one pass over the pack
    later = F.concat(F.array(F.lit(0)), F.transform(F.slice("e", 1, F.size("e") - 1), lambda x: x["day"]))
    return packs.select(
        "ty", "tx", "s", "y", F.size("e").alias("n"),
        F.zip_with("e", later, lambda x, before: x["day"] - before).alias("steps"),
        F.transform("e", lambda x: x["idx"]).alias("places"),
    )


def tile_delta_decode(packs: DataFrame, cfg: Config) -> DataFrame:
    """Packs -> cell-days (d, yi, xi, s): a running sum of the steps inside every pack."""
    t = cfg.box_tile
    entries = packs.select(
        "ty", "tx", "s", "y", F.posexplode(F.arrays_zip("steps", "places")).alias("pos", "e")
    )
    w = Window.partitionBy("ty", "tx", "s", "y").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("e.places")
    return entries.withColumn("day", F.sum("e.steps").over(w).cast("int")).select(
        F.date_add(F.make_date(F.col("y"), F.lit(1), F.lit(1)), F.col("day")).alias("d"),
        (F.col("ty") * t + F.floor(place / t)).cast("int").alias("yi"),
        (F.col("tx") * t + place % t).cast("int").alias("xi"),
        "s",
    )


def decoded_daily(packs: DataFrame, bbox: tuple, cfg: Config) -> DataFrame:
    """Cell-days per day and sensor inside a box, from packs alone (only the box's tiles are opened)."""
    from embergrid.operators.grid import cell_bounds

    y0, y1, x0, x1 = cell_bounds(bbox, cfg)
    t = cfg.box_tile
    touched = packs.filter(F.col("ty").between(y0 // t, y1 // t) & F.col("tx").between(x0 // t, x1 // t))
    cells = tile_delta_decode(touched, cfg)
    return (
        cells.filter(F.col("yi").between(y0, y1) & F.col("xi").between(x0, x1))
        .groupBy("d", "s")
        .agg(F.count(F.lit(1)).alias("cells"))
    )
