"""Areas against a plain ray cast, on random polygons, borders and boxes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from embergrid import Config
from embergrid.operators import geo

CFG = Config()


def ring_state(ring, x, y):
    """1 inside, 0 on the border, -1 outside; ring: closed list of integer points."""
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        c = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if c == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return 0
        if (y1 > y) != (y2 > y):
            if (y2 > y1 and c > 0) or (y2 < y1 and c < 0):
                inside = not inside
    return 1 if inside else -1


def inside(polys, x, y):
    for poly in polys:
        states = [ring_state(r, x, y) for r in poly]
        if states[0] == 0 or (states[0] > 0 and all(s <= 0 for s in states[1:])):
            return True
        if any(s == 0 for s in states[1:]):
            return True
    return False


def star(rng, cx, cy, r0, r1, n):
    import math

    pts = []
    for i in range(n):
        a, r = 2 * math.pi * i / n, rng.uniform(r0, r1)
        pts.append((round(cx + r * math.cos(a)), round(cy + r * math.sin(a))))
    return [*pts, pts[0]]


@pytest.fixture(scope="module")
def areas():
    rng = random.Random(7)
    out = {}
    for a in range(12):
        cx, cy = rng.randrange(-60000, 60000), rng.randrange(-40000, 40000)
        out[a] = [[star(rng, cx, cy, 6000, 16000, 14), star(rng, cx, cy, 1000, 4000, 8)]]
        if a % 3 == 0:  # two parts
            out[a].append([star(rng, cx + 60000, cy, 3000, 9000, 9)])
    # borders that run exactly through cell centres: level, upright and diagonal
    out[100] = [[[(500, 500), (4500, 500), (4500, 3500), (500, 3500), (500, 500)]]]
    out[101] = [[[(10500, 500), (13500, 3500), (10500, 3500), (10500, 500)]]]
    return out


@pytest.fixture(scope="module")
def edges(spark, areas):
    rows = [
        (a, p, r, *q1, *q2)
        for a, polys in areas.items() for p, poly in enumerate(polys) for r, ring in enumerate(poly) for q1, q2 in zip(ring, ring[1:])
    ]
    return spark.createDataFrame(rows, "area int, poly int, ring int, x1 long, y1 long, x2 long, y2 long")


def test_cells_by_scanline_equal_a_ray_cast(spark, areas, edges):
    cells = [(y, x) for y in range(-60, 61) for x in range(-80, 141)]
    df = spark.createDataFrame(cells, "yi int, xi int")
    got = {tuple(r) for r in geo.cells_in_areas(df, edges, CFG).select("area", "yi", "xi").collect()}
    want = {(a, y, x) for a, polys in areas.items() for y, x in cells if inside(polys, x * 1000 + 500, y * 1000 + 500)}
    assert got == want and len(want) > 500
    assert {(100, 0, 0), (100, 3, 4), (100, 1, 4), (101, 0, 10), (101, 2, 12)} <= got  # on the border


def test_points_equal_a_ray_cast(spark, areas, edges):
    rng = random.Random(8)
    pts = [(i, rng.randrange(-90000, 140000), rng.randrange(-60000, 60000)) for i in range(600)]
    vertices = [p for polys in areas.values() for poly in polys for ring in poly for p in ring[:-1]]
    pts += [(1000 + i, x, y) for i, (x, y) in enumerate(vertices)]
    pts += [(5000, 500, 2000), (5001, 12000, 2000), (5002, 2000, 500)]
    got = {tuple(r) for r in geo.points_in_areas(spark.createDataFrame(pts, "point_id int, x long, y long"), edges).collect()}
    assert got == {(i, a) for i, x, y in pts for a, polys in areas.items() if inside(polys, x, y)}


def test_boxes_equal_brute_force(spark, areas, edges):
    rng = random.Random(9)
    boxes = []
    for i in range(300):
        w, s = rng.uniform(-9, 13), rng.uniform(-6, 6)
        b = (w, s, w + rng.uniform(0.05, 4), s + rng.uniform(0.05, 3))
        boxes.append((i, *[round(v, 1) for v in b]) if rng.random() < 0.7 else (i, *[round(v, 4) for v in b]))
    boxes.append((900, 0.45, 0.36, 0.5, 0.4))  # touches nothing of 100 (its top is 0.35)
    boxes.append((901, 0.45, 0.35, 0.5, 0.4))  # shares one corner point with 100
    boxes.append((902, 0.2, 0.2, 0.21, 0.21))  # wholly inside 100
    boxes.append((903, -20.0, -20.0, 30.0, 30.0))  # holds everything

    def side(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    def touches(polys, b):
        w, s, e, n = [round(v * 10000) for v in b]
        corners = [(w, s), (e, s), (e, n), (w, n)]
        if any(inside(polys, *c) for c in corners):
            return True
        for poly in polys:
            for ring in poly:
                for p, q in zip(ring, ring[1:]):
                    if w <= p[0] <= e and s <= p[1] <= n:
                        return True
                    for c, d in zip(corners, corners[1:] + corners[:1]):
                        if side(p, q, c) != side(p, q, d) and side(c, d, p) != side(c, d, q):
                            return True
        return False

    df = spark.createDataFrame(boxes, "aoi_id int, w double, s double, e double, n double")
    got = {tuple(r) for r in geo.box_touches_area(df, edges).collect()}
    assert got == {(b[0], a) for b in boxes for a, polys in areas.items() if touches(polys, b[1:])}


def test_resolving_a_box_tells_ready_missing_and_nothing(spark, edges):
    boxes = spark.createDataFrame(
        [(1, 0.2, 0.2, 1.2, 0.34), (2, -30.0, -30.0, -25.0, -25.0)], "aoi_id int, w double, s double, e double, n double")
    cat = spark.createDataFrame([(a, a != 101) for a in (*range(12), 100, 101)], "area int, ready boolean")
    near = edges.filter("area >= 100")
    got = {r["aoi_id"]: r for r in geo.resolve_aoi(boxes, geo.box_touches_area(boxes, near), cat).collect()}
    assert (got[1]["have"], got[1]["missing"], got[1]["needs_data"]) == ([100], [101], False)
    assert (got[2]["have"], got[2]["missing"], got[2]["needs_data"]) == ([], [], True)


def test_extent_overlap_is_inclusive(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 20.1, 0.0, 21.0, 1.0)], "aoi_id int, w double, s double, e double, n double")
    ext = spark.createDataFrame([(7, 10.0, 10.0, 20.0, 20.0)], "area int, w double, s double, e double, n double")
    assert [tuple(r) for r in geo.box_touches_extent(boxes, ext).collect()] == [(1, 7)]


def test_names_match_without_case_accents_or_punctuation(spark):
    areas = spark.createDataFrame([(1, "Cote_d_Ivoire"), (2, "Sao_Tome"), (3, "Nowhere"), (4, "Swaziland")], "area int, name string")
    alias = spark.createDataFrame([(4, "eSwatini")], "area int, alias string")
    feats = spark.createDataFrame(
        [(10, "Ivory Coast", "Côte d'Ivoire"), (11, "São Tomé", None), (12, "Eswatini", "x"), (13, "côte d’ivoire", None)],
        "feature_id int, admin string, name_long string")
    got = {r["area"]: (r["feature_id"], r["priority"]) for r in geo.name_match(areas, feats, ("admin", "name_long"), alias).collect()}
    assert got == {1: (13, 1), 2: (11, 1), 3: (None, None), 4: (12, 1)}  # a first-column name beats a second-column one


def test_live_links_join_borders_and_own_record(spark, edges):
    live = spark.createDataFrame([(0, 0), (2, 2), (50, 50)], "yi int, xi int")
    own = spark.createDataFrame([(100, 50, 50), (100, 2, 2), (7, 90, 90)], "area int, yi int, xi int")
    inside_ = geo.cells_in_areas(live, edges.filter("area = 100"), CFG)
    got = sorted(tuple(r) for r in geo.cell_area_link(inside_, own, live).collect())
    assert got == [(100, 0, 0), (100, 2, 2), (100, 50, 50)]
    assert [tuple(r) for r in geo.own_cells_outside(own.filter("area = 100"), inside_).collect()] == [(100, 50, 50)]
    assert inside_.select(F.countDistinct("area")).first()[0] == 1


def _inside(edges, x, y):
    """Even-odd rule in exact fractions; the border belongs to the inside."""
    from fractions import Fraction

    odd = {}
    for area, poly, _, x1, y1, x2, y2 in edges:
        if (x - x1) * (y2 - y1) == (x2 - x1) * (y - y1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            odd[area, poly] = None
        elif (y1 > y) != (y2 > y) and x1 + Fraction((x2 - x1) * (y - y1), y2 - y1) < x and odd.get((area, poly), 0) is not None:
            odd[area, poly] = odd.get((area, poly), 0) + 1
    return {area for (area, _), n in odd.items() if n is None or n % 2}


def test_points_in_random_polygons_at_every_bucket_size(spark):
    rng = random.Random(17)
    edges = []
    for area in range(8):
        for poly in range(rng.choice((1, 2))):
            cx, cy, r = rng.randrange(-60, 60), rng.randrange(-60, 60), rng.choice((5, 20, 45))
            for ring in range(rng.choice((1, 1, 2))):
                n, size = rng.choice((3, 4, 7, 12)), max(2, r // (1 + 2 * ring))
                ring_points = []
                for k in range(n):
                    turn = 2 * math.pi * (k + rng.random() * 0.9) / n
                    ring_points.append((round(cx + size * math.cos(turn)), round(cy + size * math.sin(turn))))
                edges += [(area, poly, ring, *a, *b) for a, b in zip(ring_points, ring_points[1:] + ring_points[:1]) if a != b]
    edges += [(9, 0, 0, *a, *b) for a, b in zip([(-90, -90), (90, -90), (90, 90), (-90, 90)], [(90, -90), (90, 90), (-90, 90), (-90, -90)])]
    points = sorted({(e[3], e[4]) for e in edges} | {(rng.randrange(-110, 110), rng.randrange(-110, 110)) for _ in range(1500)})
    df = spark.createDataFrame(edges, "area int, poly int, ring int, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    p = spark.createDataFrame([(i, *xy) for i, xy in enumerate(points)], "point_id int, x bigint, y bigint")
    want = {(i, a) for i, xy in enumerate(points) for a in _inside(edges, *xy)}
    for bucket in (1, 4, 10, 37, 2500):
        assert {tuple(r) for r in geo.points_in_areas(p, df, bucket).collect()} == want, bucket
    assert 1000 < len(want) < 6000


def test_a_point_meets_the_edges_of_its_bucket_only(spark):
    # one area per degree along the equator: all edges share their latitude rows
    edges = []
    for a in range(300):
        x = a * 10_000
        ring = [(x + 1000, -3000), (x + 9000, -3000), (x + 9000, 3000), (x + 1000, 3000)]
        edges += [(a, 0, 0, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]
    df = spark.createDataFrame(edges, "area int, poly int, ring int, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    slab = geo.slab_map(df).cache()
    assert slab.groupBy("row", "col").agg(F.countDistinct("area").alias("n")).agg(F.max("n")).first()[0] == 1
    assert slab.filter("xl is null").count() == 300 * 4  # buckets wholly inside
    p = spark.createDataFrame([(a, a * 10_000 + dx, 0) for a in range(300) for dx in (500, 5000)], "point_id int, x bigint, y bigint")
    assert {tuple(r) for r in geo.points_in_areas(p, df).collect()} == {(a, a) for a in range(300)}
    slab.unpersist()
