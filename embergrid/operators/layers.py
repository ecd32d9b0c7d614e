"""Map layers: fine-sensor-equivalent fire days per cell for the record, each year, each month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from embergrid.config import Config
from embergrid.functions.cells import cell_index, floor_div, in_tile
from embergrid.functions.dates import day
from embergrid.functions.numbers import half_even
from embergrid.operators.quantiles import grouped_quantile
from embergrid.session import materialize


def area_ratios(ratios: DataFrame) -> DataFrame:
    """(area, k, kt): the all-month ratios a map uses (3 decimals, 1 where they vanish)."""
    some = lambda c: F.when(half_even(c, 3) == 0, F.lit(1.0)).otherwise(half_even(c, 3))
    return ratios.filter("mon = 1").select("area", some(F.col("k_area")).alias("k"), some(F.col("kt_area")).alias("kt"))


def _read_as(grid: DataFrame, calendar: DataFrame, strips: DataFrame, cfg: Config) -> DataFrame:
    """Adds role: 'v' (fine counts), 'm' (coarse times k), 't' (platform A times kt) or NULL (counts nothing).

    Calendar and strips are bounded by the days of the record: broadcast.
    """
    flags = calendar.select("d", "fine_out", "b_out", "unknown")
    lost = strips.select("d", F.col("band").alias("_band"), F.lit(True).alias("_lost"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    s, d = F.col("s"), F.col("d")
    fine_day = (d >= day(cfg.fine_start)) & ~no("_lost") & ~no("fine_out")
    both = (d >= day(cfg.platform_b_start)) & ~no("b_out")
    role = (
        F.when(no("unknown"), F.lit(None).cast("string"))
        .when(fine_day, F.when(s == 1, "v"))
        .when(both, F.when(s == 0, "m"))
        .otherwise(F.when(s == 2, "t"))
    )
    return (
        grid.filter(d <= day(cfg.record_end))
        .withColumn("_band", floor_div(F.col("xi"), cfg.strip_cells))
        .join(F.broadcast(flags), "d", "left")
        .join(lost, ["d", "_band"], "left")
        .withColumn("role", role)
        .drop("_band", "_lost", "fine_out", "b_out", "unknown")
    )


def fine_equivalent(
    grid: DataFrame, calendar: DataFrame, strips: DataFrame, ratios: DataFrame, scale: DataFrame, cfg: Config
) -> DataFrame:
    """Every cell-day row's value (row form of ``cell_months``)."""
    rows = _read_as(grid, calendar, strips, cfg).withColumns({"y": F.year("d"), "mon": F.month("d")})
    joined = rows.join(area_ratios(ratios), "area", "left").join(scale, ["area", "y", "mon"], "left")
    r = F.col("role")
    val = F.when(r == "v", 1.0).when(r == "m", F.col("k")).when(r == "t", F.col("kt")).otherwise(0.0)
    return joined.select(
        "area", "d", "yi", "xi", "s", (val * F.coalesce("scale", F.lit(1.0))).alias("val")
    )


def cell_months(
    grid: DataFrame, calendar: DataFrame, strips: DataFrame, ratios: DataFrame, scale: DataFrame, cfg: Config
) -> DataFrame:
    """(area, y, mon, xi, yi, val): the base of every layer.

    Rows are counted per role first; ratios and month factors join the far smaller monthly counts, so
    no per-row join on area moves the cell-day table.
    """
    r = F.col("role")
    counts = (
        _read_as(grid, calendar, strips, cfg)
        .filter(r.isNotNull())
        .groupBy("area", F.year("d").alias("y"), F.month("d").alias("mon"), "xi", "yi")
        .agg(*[F.count_if(r == c).alias(f"n_{c}") for c in ("v", "m", "t")])
    )
    val = F.col("n_v") + F.col("n_m") * F.col("k") + F.col("n_t") * F.col("kt")
    return (
        counts.join(area_ratios(ratios), "area")
        .join(scale, ["area", "y", "mon"], "left")
        .select("area", "y", "mon", "xi", "yi", (val * F.coalesce("scale", F.lit(1.0))).alias("val"))
        .filter("val > 0")
    )


def layer_years(days: DataFrame) -> DataFrame:
    """(layer, years) a multi-year layer averages over, from the record's days (column d, any repeats)."""
    d = days.select("d").distinct()
    whole = d.agg((F.count(F.lit(1)) / 365.2425).alias("years")).select(F.lit("all").alias("layer"), "years")
    months = (
        d.filter(F.dayofmonth("d") == 1)
        .groupBy(F.month("d").alias("mon"))
        .agg(F.count(F.lit(1)).cast("double").alias("years"))
        .select(F.format_string("m%02d", F.col("mon")).alias("layer"), "years")
    )
    return whole.unionByName(months)


def area_layers(months: DataFrame, years: DataFrame) -> DataFrame:
    """(layer, area, xi, yi, val) for the whole record, every year and every calendar month in one job.

    ``years`` has 13 rows at most: broadcast.
    """
    cube = months.groupingSets(
        [["area", "xi", "yi"], ["area", "xi", "yi", "y"], ["area", "xi", "yi", "mon"]], "area", "xi", "yi", "y", "mon"
    ).agg(F.sum("val").alias("total"))
    layer = (
        F.when(F.col("y").isNotNull(), F.format_string("y%d", F.col("y")))
        .when(F.col("mon").isNotNull(), F.format_string("m%02d", F.col("mon")))
        .otherwise("all")
    )
    return (
        cube.withColumn("layer", layer)
        .join(F.broadcast(years), "layer", "left")
        .select("layer", "area", "xi", "yi", (F.col("total") / F.coalesce("years", F.lit(1.0))).alias("val"))
    )


def multi_area_max(layers: DataFrame) -> DataFrame:
    """Where borders share a cell the larger value holds."""
    return layers.groupBy("layer", "xi", "yi").agg(F.max("val").alias("val"))


def published_layers(months: DataFrame, years: DataFrame, cfg: Config) -> DataFrame:
    return multi_area_max(area_layers(months, years)).filter(F.col("val") >= cfg.layer_min)


def layer_scale(layers: DataFrame) -> DataFrame:
    """99th percentile of every layer's cells: one colour scale for the whole map."""
    return grouped_quantile(layers, ["layer"], "val", 0.99).select(
        "layer", F.col("n").alias("cells"), half_even(F.col("quantile"), 2).alias("max_value")
    )


def overview(layers: DataFrame, cfg: Config) -> DataFrame:
    """Fixed blocks of ``overview`` cells a side, mean per cell, faint blocks dropped."""
    f = cfg.overview
    return (
        layers.groupBy("layer", floor_div(F.col("xi"), f).alias("bx"), floor_div(F.col("yi"), f).alias("by"))
        .agg((F.sum("val") / (f * f)).alias("val"))
        .filter(F.col("val") >= cfg.overview_min)
        .select("layer", "bx", "by", half_even(F.col("val"), 2).alias("val"))
    )


def map_tiles(layers: DataFrame, cfg: Config) -> DataFrame:
    ty, tx, _ = in_tile(F.col("yi"), F.col("xi"), cfg.map_tile)
    return layers.select("layer", ty.alias("ty"), tx.alias("tx"), "xi", "yi", half_even(F.col("val"), 1).alias("val"))


def tile_index(cells: DataFrame, tile: int, *keys: str) -> DataFrame:
    """Rows per tile."""
    ty, tx, _ = in_tile(F.col("yi"), F.col("xi"), tile)
    return cells.groupBy(*keys, ty.alias("ty"), tx.alias("tx")).agg(F.count(F.lit(1)).alias("cells"))


def viewport_cells(cells: DataFrame, bbox: tuple, cfg: Config, margin: bool = False) -> DataFrame:
    """Cells of a box: exactly its grid cells, or every square that meets it plus one square around."""
    w, s, e, n = bbox
    c = 1.0 / cfg.cell
    if not margin:
        from embergrid.operators.grid import cell_bounds

        y0, y1, x0, x1 = cell_bounds(bbox, cfg)
        return cells.filter(F.col("yi").between(y0, y1) & F.col("xi").between(x0, x1))
    x, y = F.col("xi"), F.col("yi")
    return cells.filter(
        ((x + 1) * c >= w - c) & (x * c <= e + c) & ((y + 1) * c >= s - c) & (y * c <= n + c)
    )


def coarsen(cells: DataFrame, limit: int, how: str = "mean", keys: tuple[str, ...] = ()) -> DataFrame:
    """Merge f x f blocks, f the smallest side that leaves at most ``limit`` squares per key: keys, f, bx, by, val.

    A pyramid gives the answer: blocks of side 1, 2, 4, ... come from the level below, only for the keys that do not fit
    yet. The first power of two that fits bounds f from above. A side is ruled out when some level has more blocks than
    ``limit`` squares of that side can meet (a square of side f meets f / g blocks of side g an axis if g divides f, one if f
    divides g, at most floor((f - 1) / g) + 2 otherwise). Only what is left is tried, each side from the coarsest level that
    divides it, and the squares of the answer come from that level too.
    """
    if limit < 4:
        raise ValueError("cells on both sides of the origin's corner need 4 squares whatever their size")
    k = list(keys) or ["_all"]
    src = cells if keys else cells.withColumn("_all", F.lit(0))
    side, levels, sizes = 1, [], []
    blocks = src.groupBy(*k, F.col("xi").alias("bx"), F.col("yi").alias("by")).agg(F.sum("val").alias("val"))
    while True:
        level = materialize(blocks, "blocks")
        size = materialize(level.groupBy(*k).agg(F.count(F.lit(1)).alias("blocks")), "block_counts")
        levels.append(level.withColumn("g", F.lit(side)))
        sizes.append(size.withColumn("g", F.lit(side)))
        crowded = size.filter(F.col("blocks") > limit)
        if crowded.isEmpty():
            break
        half = lambda c: floor_div(F.col(c), 2).alias(c)
        blocks = level.join(crowded.select(*k), k, "left_semi").groupBy(*k, half("bx"), half("by")).agg(F.sum("val").alias("val"))
        side *= 2
    level, size = reduce(DataFrame.unionByName, levels), reduce(DataFrame.unionByName, sizes)

    known = size.groupBy(*k).agg(F.max("g").alias("fits"), F.collect_list(F.struct("g", "blocks")).alias("known"))  # a row per level
    left = known.withColumn("f", F.explode(F.filter(
        F.sequence(F.lit(1), F.col("fits")), lambda f: (f == F.col("fits")) | ~F.exists("known", lambda x: _too_many(f, x, limit))
    ))).drop("known")
    tried = left.filter("f < fits").select(*k, "f", _divisor(F.col("f")).alias("g"))
    meets = (
        level.join(tried, [*k, "g"]).select(*k, "f", *_merged_into("f"))
        .distinct().groupBy(*k, "f").agg(F.count(F.lit(1)).alias("blocks")).filter(F.col("blocks") <= limit)
    )
    best = meets.select(*k, "f").unionByName(left.filter("f = fits").select(*k, "f")).groupBy(*k).agg(F.min("f").alias("f"))
    best = materialize(best.withColumn("g", _divisor(F.col("f"))), "sides")
    merged = level.join(best, [*k, "g"]).groupBy(*k, "f", *_merged_into("f")).agg(F.sum("val").alias("total"))
    val = F.col("total") / (F.col("f") * F.col("f")) if how == "mean" else F.col("total")
    return merged.select(*keys, "f", "bx", "by", val.alias("val"))


def _too_many(f: Column, level: Column, limit: int) -> Column:
    """Whether a pyramid level (g, blocks) proves that squares of side f are more than ``limit``."""
    g = level["g"]
    met = F.when(f % g == 0, F.floor(f / g)).when(g % f == 0, 1).otherwise(F.floor((f - 1) / g) + 2)
    return level["blocks"] > met * met * limit


def _divisor(f: Column) -> Column:
    """Largest power of two that divides f."""
    return f.bitwiseAND(-f)


def _merged_into(f: str) -> list[Column]:
    """Blocks of level ``g`` -> squares of side ``f``."""
    step = F.col(f) / F.col("g")
    return [F.floor(F.col(c) / step).cast("int").alias(c) for c in ("bx", "by")]


def coarsened_map(cells: DataFrame, limit: int, cfg: Config, how: str = "mean", keys: tuple[str, ...] = ()) -> DataFrame:
    """``coarsen`` with what a map needs besides: cell (side of a square in degrees) and max (its colour scale, the 99th
    percentile of the key's squares, of which there are at most ``limit``)."""
    squares = coarsen(cells, limit, how, keys)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    return squares.withColumns({
        "cell": F.col("f") / float(cfg.cell), "max": half_even(F.expr("percentile(val, 0.99)").over(whole), 2),
    })
