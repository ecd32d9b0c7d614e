"""Areas as polygons: cells inside, points inside, boxes touching. Touching a border counts.

Borders are edges (area, poly, ring, x1, y1, x2, y2) in whole units of 1e-4 degrees, so every test is
exact. Nothing here depends on the number of detections: callers pass distinct cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from embergrid.config import Config
from embergrid.functions.cells import box_cells

UNITS = 10_000  # per degree
CHUNK = 64  # columns per span piece
BUCKET = 2_500  # bucket side of the point test
BLOCK = 10_000  # bucket side of the box test


def _fdiv(a: Column, b) -> Column:
    return F.floor(a / b).cast("bigint")


def area_spans(edges: DataFrame, cfg: Config) -> DataFrame:
    """(area, yi, x0, x1): runs of cells whose centres lie inside or on the border, row by row.

    Each cell row's centre line crosses a polygon's rings at sorted columns; crossings pair up into
    inside runs (holes drop out by the same rule). Centres exactly on an edge are added as own runs.
    The result is bounded by the grid, not by the data.
    """
    u = UNITS // cfg.cell
    h = u // 2
    up = F.col("y1") < F.col("y2")
    e = edges.select(
        "area", "poly",
        F.when(up, F.col("x1")).otherwise(F.col("x2")).alias("xl"), F.least("y1", "y2").alias("yl"),
        F.when(up, F.col("x2")).otherwise(F.col("x1")).alias("xh"), F.greatest("y1", "y2").alias("yh"),
    )
    # centre lines yl <= y <= yh
    rows = e.withColumn("lo", -_fdiv(h - F.col("yl"), u)).withColumn("hi", _fdiv(F.col("yh") - h, u))
    rows = rows.filter("lo <= hi").withColumn("yi", F.explode(F.sequence("lo", "hi")))
    y, den = F.col("yi") * u + h, F.col("yh") - F.col("yl")
    num = F.col("xl") * den + (F.col("xh") - F.col("xl")) * (y - F.col("yl")) - h * den
    slanted = rows.filter("yl < yh").withColumns({"num": num, "den": den * u, "top": y == F.col("yh")})
    order = Window.partitionBy("area", "poly", "yi").orderBy("first")
    inside = (
        slanted.filter("not top")
        .withColumn("first", _fdiv(F.col("num"), F.col("den")) + 1)
        .select(
            "area", "yi", F.row_number().over(order).alias("rn"), F.col("first").alias("x0"),
            (F.lead("first").over(order) - 1).alias("x1"),
        )
        .filter("rn % 2 = 1 and x0 <= x1")
        .select("area", "yi", "x0", "x1")
    )
    on = slanted.filter("num % den = 0").select("area", "yi", _fdiv(F.col("num"), F.col("den")).alias("x0"))
    level = rows.filter("yl = yh").select(
        "area", "yi",
        (-_fdiv(h - F.least("xl", "xh"), u)).alias("x0"), _fdiv(F.greatest("xl", "xh") - h, u).alias("x1"),
    )
    return inside.unionByName(on.withColumn("x1", F.col("x0"))).unionByName(level.filter("x0 <= x1"))


def cells_in_areas(cells: DataFrame, edges: DataFrame, cfg: Config) -> DataFrame:
    """(area, yi, xi) for every cell and every area that holds its centre."""
    return cells_in_spans(cells, area_spans(edges, cfg))


def cells_in_spans(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """``cells_in_areas`` from spans at hand: they depend on the borders only."""
    spans = spans.withColumn(
        "chunk", F.explode(F.sequence(_fdiv(F.col("x0"), CHUNK), _fdiv(F.col("x1"), CHUNK)))
    ).withColumn("yi", F.col("yi").cast("int"))
    own = cells.select("yi", "xi").distinct().withColumn("chunk", _fdiv(F.col("xi"), CHUNK))
    hit = own.join(spans, ["yi", "chunk"]).filter(F.col("xi").between(F.col("x0"), F.col("x1")))
    return hit.select("area", "yi", "xi").distinct()


def slab_map(edges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Borders cut into square buckets: row, col, area, poly, inside, xl, yl, xh, yh (an edge from its lower to its upper end).

    Coordinates are doubled, so bucket sides run at odd numbers and never meet a vertex. ``inside`` tells whether the
    bucket's lower left corner lies in the polygon. Every edge is listed in the buckets it touches; a bucket that no edge
    touches has one row, without an edge, if it lies in the polygon, and none if it lies outside. The size is bounded by the
    borders and the land they enclose, whatever the points.
    """
    up = F.col("y1") <= F.col("y2")
    pick = lambda low, high: 2 * F.when(up, F.col(low)).otherwise(F.col(high))
    e = edges.select("area", "poly", pick("x1", "x2").alias("xl"), pick("y1", "y2").alias("yl"), pick("x2", "x1").alias("xh"), pick("y2", "y1").alias("yh"))
    size = 2 * bucket
    at = lambda v: _fdiv(v + 1, size)  # noqa: E731  the bucket of a doubled coordinate
    base = F.col("row") * size - 1
    den, width = F.col("yh") - F.col("yl"), F.col("xh") - F.col("xl")

    by_row = e.withColumn("row", F.explode(F.sequence(at(F.col("yl")), at(F.col("yh")))))
    # columns an edge touches in a row, one unit of slack: an edge listed too often is never counted
    part = lambda y: F.col("xl") + F.when(den > 0, width * ((y - F.col("yl")) / den)).otherwise(F.lit(0.0))
    a, b = part(F.greatest(base, F.col("yl"))), F.when(den > 0, part(F.least(base + size, F.col("yh")))).otherwise(F.col("xh"))
    pieces = by_row.withColumn("col", F.explode(F.sequence(at(F.floor(F.least(a, b)) - 1), at(F.ceil(F.greatest(a, b)) + 1))))

    # corners: each edge that crosses a bucket row's lower side turns all corners to its right
    crossing = by_row.filter((F.col("yl") < base) & (F.col("yh") > base))
    num = F.col("xl") * den + width * (base - F.col("yl"))
    exact = F.pmod(num + den, den * size) == 0
    first = _fdiv(num + den, den * size) + F.when(exact & (width < 0), 0).otherwise(1)
    order = Window.partitionBy("area", "poly", "row").orderBy("first")
    corners = (
        crossing.withColumn("first", first)
        .select("area", "poly", "row", F.row_number().over(order).alias("rn"), F.col("first").alias("c0"), (F.lead("first").over(order) - 1).alias("c1"))
        .filter("rn % 2 = 1 and c0 <= c1")
        .select("area", "poly", "row", F.explode(F.sequence("c0", "c1")).alias("col"), F.lit(1).alias("corner"))
    )
    key = ["area", "poly", "row", "col"]
    return pieces.join(corners, key, "full").select(*key, F.coalesce("corner", F.lit(0)).alias("inside"), "xl", "yl", "xh", "yh")


def points_in_areas(points: DataFrame, edges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(point_id, area) for arbitrary points (point_id, x, y in border units); a point on a border is inside.

    Points meet the edges of their bucket only. From the bucket's corner a path leads up its left side and then to the
    right to the point; the edges it crosses turn the corner's side into the point's. All tests are in whole numbers.
    """
    p = points.select("point_id", "x", "y").distinct().select(
        "point_id", (2 * F.col("x")).alias("x"), (2 * F.col("y")).alias("y"), _fdiv(F.col("x"), bucket).alias("col"), _fdiv(F.col("y"), bucket).alias("row")
    )
    x, y, xl, yl, xh, yh = (F.col(c) for c in ("x", "y", "xl", "yl", "xh", "yh"))
    left, base = F.col("col") * (2 * bucket) - 1, F.col("row") * (2 * bucket) - 1
    den, width = yh - yl, xh - xl
    cross = (x - xl) * den - width * (y - yl)
    on = (cross == 0) & x.between(F.least(xl, xh), F.greatest(xl, xh)) & y.between(yl, yh)
    # a hair above the point's height, so a vertex at that height belongs to one of its edges
    right_of_side = width * (y - yl) - (left - xl) * den
    rightwards = (yl <= y) & (yh > y) & ((right_of_side > 0) | ((right_of_side == 0) & (width > 0))) & (cross > 0)
    rise = den * (left - xl)  # over width: height above the lower end at which the edge meets the left side
    signed = lambda h: F.when(width > 0, (h - yl) * width - rise).otherwise(rise - (h - yl) * width)  # noqa: E731  > 0: h is above that
    upwards = (F.least(xl, xh) < left) & (F.greatest(xl, xh) > left) & (signed(base) < 0) & (signed(y) >= 0)
    turns = F.coalesce(rightwards.cast("int"), F.lit(0)) + F.coalesce(upwards.cast("int"), F.lit(0))
    return (
        p.join(slab_map(edges, bucket), ["row", "col"])
        .groupBy("point_id", "area", "poly")
        .agg(F.max("inside").alias("corner"), F.coalesce(F.bool_or(on), F.lit(False)).alias("on"), F.sum(turns).alias("turns"))
        .filter("on or (corner + turns) % 2 = 1")
        .select("point_id", "area")
        .distinct()
    )


def units(degrees: Column) -> Column:
    return F.floor(degrees * UNITS + 0.5).cast("bigint")


def box_touches_area(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """(aoi_id, area): boxes that meet an area, inclusive of its border.

    Either an edge meets the box, or the box lies wholly inside and one corner tells. Boxes and edges
    meet through 1-degree buckets.
    """
    b = boxes.select("aoi_id", *[units(F.col(c)).alias(f"b{c}") for c in ("w", "s", "e", "n")])
    buckets = lambda lo, hi: F.explode(F.sequence(_fdiv(lo, BLOCK), _fdiv(hi, BLOCK)))
    spread = b.withColumn("bx", buckets(F.col("bw"), F.col("be"))).withColumn("by", buckets(F.col("bs"), F.col("bn")))
    e = edges.withColumn("bx", buckets(F.least("x1", "x2"), F.greatest("x1", "x2"))).withColumn(
        "by", buckets(F.least("y1", "y2"), F.greatest("y1", "y2"))
    )
    side = lambda x, y: F.signum(
        (F.col("x2") - F.col("x1")) * (F.col(y) - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col(x) - F.col("x1"))
    )
    corners = [side(x, y) for x in ("bw", "be") for y in ("bs", "bn")]
    meets = (
        (F.greatest("x1", "x2") >= F.col("bw")) & (F.least("x1", "x2") <= F.col("be"))
        & (F.greatest("y1", "y2") >= F.col("bs")) & (F.least("y1", "y2") <= F.col("bn"))
        & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)
    )
    by_edge = spread.join(e, ["bx", "by"]).filter(meets).select("aoi_id", "area")
    corner = b.select(F.col("aoi_id").alias("point_id"), F.col("bw").alias("x"), F.col("bs").alias("y"))
    by_corner = points_in_areas(corner, edges).select(F.col("point_id").alias("aoi_id"), "area")
    return by_edge.unionByName(by_corner).distinct()


def box_touches_extent(boxes: DataFrame, extents: DataFrame, side_deg: float = 10.0) -> DataFrame:
    """Boxes against the data extent of areas without a border (inclusive), through coarse buckets."""
    span = lambda lo, hi: F.explode(F.sequence(_fdiv(F.col(lo), side_deg), _fdiv(F.col(hi), side_deg)))
    b = boxes.select("aoi_id", *[F.col(c).alias(f"b{c}") for c in ("w", "s", "e", "n")])
    b = b.withColumn("bx", span("bw", "be")).withColumn("by", span("bs", "bn"))
    x = extents.select("area", "w", "s", "e", "n").withColumn("bx", span("w", "e")).withColumn("by", span("s", "n"))
    overlap = (F.col("e") >= F.col("bw")) & (F.col("w") <= F.col("be")) & (F.col("n") >= F.col("bs")) & (F.col("s") <= F.col("bn"))
    return b.join(x, ["bx", "by"]).filter(overlap).select("aoi_id", "area").distinct()


def resolve_aoi(boxes: DataFrame, touches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per box: the touched areas that are ready, those that are missing, and whether anything can be shown."""
    listed = touches.join(catalogue.select("area", "ready"), "area")
    # an array holds area ids, at most the catalogue
    ids = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("area"))))
    per_box = listed.groupBy("aoi_id").agg(ids(F.col("ready")).alias("have"), ids(~F.col("ready")).alias("missing"))
    none = F.array().cast("array<int>")
    return (
        boxes.select("aoi_id")
        .join(per_box, "aoi_id", "left")
        .select("aoi_id", F.coalesce("have", none).alias("have"), F.coalesce("missing", none).alias("missing"))
        .withColumn("needs_data", F.size("have") == 0)
    )


def own_cells_outside(cells: DataFrame, inside: DataFrame) -> DataFrame:
    """An area's recorded cells whose centre is outside its own border."""
    return cells.select("area", "yi", "xi").join(inside, ["area", "yi", "xi"], "left_anti")


def cell_area_link(inside: DataFrame, own: DataFrame, live_cells: DataFrame) -> DataFrame:
    """Live cells to areas: by border, or because the area's own record holds the cell."""
    cells = live_cells.select("yi", "xi").distinct()
    recorded = own.select("area", "yi", "xi").join(cells, ["yi", "xi"], "left_semi")
    return inside.select("area", "yi", "xi").unionByName(recorded.select("area", "yi", "xi")).distinct()


def bbox_normalize(boxes: DataFrame, cfg: Config) -> DataFrame:
    """Every box with a status: clamped to the globe, 3 decimals, ``ok``; ``empty`` and ``too large`` boxes have NULL sides."""
    from embergrid.functions.numbers import half_even

    w, e = F.greatest(F.lit(-180.0), F.col("w")), F.least(F.lit(180.0), F.col("e"))
    s, n = F.greatest(F.lit(-90.0), F.col("s")), F.least(F.lit(90.0), F.col("n"))
    rounded = {c: half_even(v, 3) for c, v in (("w", w), ("s", s), ("e", e), ("n", n))}
    size = (rounded["e"] - rounded["w"]) * (rounded["n"] - rounded["s"])
    status = F.when((w < e) & (s < n), F.when(size <= cfg.max_box_deg2, "ok").otherwise("too large")).otherwise("empty")
    judged = boxes.withColumns({"status": status, **{f"_{c}": v for c, v in rounded.items()}})
    sides = [F.when(F.col("status") == "ok", F.col(f"_{c}")).alias(c) for c in ("w", "s", "e", "n")]
    return judged.select("aoi_id", *sides, "status")


def bbox_cells(boxes: DataFrame, cfg: Config) -> DataFrame:
    y0, y1, x0, x1 = box_cells(*[F.col(c) for c in ("w", "s", "e", "n")], cfg.cell)
    return boxes.select("aoi_id", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))


def area_around(points: DataFrame, half: float = 0.25) -> DataFrame:
    """A box around a clicked point (lat, lon), kept on the globe, 2 decimals (half up, as a browser rounds)."""
    r2 = lambda v: F.floor(v * 100 + 0.5) / 100
    return points.withColumns(
        {
            "w": r2(F.greatest(F.lit(-180.0), F.col("lon") - half)),
            "s": r2(F.greatest(F.lit(-90.0), F.col("lat") - half)),
            "e": r2(F.least(F.lit(180.0), F.col("lon") + half)),
            "n": r2(F.least(F.lit(90.0), F.col("lat") + half)),
        }
    )


def normal_name(name: Column) -> Column:
    """Letters only, compared without case or accents."""
    return F.collate(F.regexp_replace(F.lower(name), r"[^\p{L}]", ""), "UNICODE_CI_AI")


def name_match(areas: DataFrame, features: DataFrame, name_columns: tuple[str, ...], aliases: DataFrame) -> DataFrame:
    """(area, feature_id, priority): the border feature of every area by name.

    Name columns are tried in order; an alias (area, alias) replaces the area's own name. An area that no feature
    answers to stays, with NULL: it has no shape.
    """
    wanted = areas.join(aliases, "area", "left").select(
        "area", normal_name(F.coalesce("alias", F.regexp_replace("name", "_", " "))).alias("k")
    )
    named = F.array(
        *[F.struct(F.lit(i).alias("priority"), F.col(c).alias("v")) for i, c in enumerate(name_columns, start=1)]
    )
    known = (
        features.select("feature_id", F.inline(named))
        .filter(F.col("v").isNotNull())
        .select("feature_id", "priority", normal_name(F.col("v")).alias("k"))
        .groupBy("k")
        .agg(F.min(F.struct("priority", "feature_id")).alias("f"))
    )
    return wanted.join(known, "k", "left").select("area", F.col("f.feature_id").alias("feature_id"), F.col("f.priority").alias("priority"))
