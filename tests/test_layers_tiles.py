"""Layers, coarsening, quantiles and packed tiles against plain computations."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from embergrid import Config
from embergrid.operators import grid, harmonize, layers, tiles
from embergrid.operators.quantiles import grouped_quantile
from tests.synthetic import no_outages, no_strips

CFG = Config()


def test_quantiles_are_exact_on_skewed_and_repeated_values(spark):
    rng = np.random.default_rng(1)
    groups = {
        "flat": np.full(500, 3.25), "pair": np.array([1.0, 2.0]), "one": np.array([7.5]),
        "heavy": np.concatenate([np.zeros(4000), rng.pareto(0.4, 900) * 1e6]), "negative": rng.normal(0, 1e-9, 999),
        "whole": rng.integers(0, 4, 2000).astype(float),
    }
    pdf = pd.concat([pd.DataFrame({"g": k, "x": v}) for k, v in groups.items()])
    df = spark.createDataFrame(pdf)
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        got = {r["g"]: r for r in grouped_quantile(df, ["g"], "x", q).collect()}
        near = {r["g"]: r["quantile"] for r in grouped_quantile(df, ["g"], "x", q, nearest=True).collect()}
        for k, v in groups.items():
            assert got[k]["quantile"] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-20) and got[k]["n"] == len(v)
            assert near[k] == np.sort(v)[min(len(v) - 1, math.floor(q * len(v)))]


def plain_coarsen(cells, limit, how):
    f, out = 1, cells
    while len(out) > limit:
        f += 1
        sums = {}
        for x, y, v in cells:
            sums[x // f, y // f] = sums.get((x // f, y // f), 0) + v
        out = [(a, b, v / (f * f if how == "mean" else 1)) for (a, b), v in sums.items()]
    return f, sorted(out)


@pytest.mark.parametrize("limit,how", [(9, "mean"), (40, "sum"), (333, "mean"), (5000, "sum")])
def test_coarsening_finds_the_smallest_side_that_fits(spark, limit, how):
    rng = np.random.default_rng(limit)
    cells = {(int(x), int(y)) for x, y in rng.integers(-90, 90, (700, 2))} | {(x, 3) for x in range(400)}
    rows = [(x, y, float(i % 7 + 1)) for i, (x, y) in enumerate(sorted(cells))]
    got = layers.coarsen(spark.createDataFrame(rows, "xi int, yi int, val double"), limit, how).collect()
    f, want = plain_coarsen(rows, limit, how)
    assert {r["f"] for r in got} == {f}
    assert [(a, b) for a, b, _ in want] == sorted((r["bx"], r["by"]) for r in got)
    assert sorted(r["val"] for r in got) == pytest.approx(sorted(v for *_, v in want))


def test_every_key_gets_its_own_side_cell_and_scale(spark):
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for key in range(30):
        n, span = int(rng.choice([1, 5, 60, 400])), int(rng.choice([3, 20, 300, 5000]))
        step = int(rng.choice([1, 3, 5]))
        cells = sorted({(int(x) * step, int(y) * step) for x, y in rng.integers(-span, span, (n, 2))})
        cells = [(x, y, float(i % 11 + 1)) for i, (x, y) in enumerate(cells)]
        rows += [("map", key, *c) for c in cells]
        for how in ("mean", "sum"):
            f, squares = plain_coarsen(cells, 7, how)
            want[how, key] = (f, round(float(np.quantile([v for *_, v in squares], 0.99)), 2), squares)
    df = spark.createDataFrame(rows, "layer string, area int, xi int, yi int, val double")
    for how in ("mean", "sum"):
        got = {}
        for r in layers.coarsened_map(df, 7, CFG, how, ("layer", "area")).collect():
            got.setdefault(r["area"], []).append(r)
        assert len(got) == 30
        for key, squares in got.items():
            f, scale, plain = want[how, key]
            assert {r["f"] for r in squares} == {f} and {r["cell"] for r in squares} == {f / 10}
            assert all(abs(r["max"] - scale) <= 0.0101 for r in squares)
            assert sorted((r["bx"], r["by"]) for r in squares) == [(a, b) for a, b, _ in plain]
            assert sorted(r["val"] for r in squares) == pytest.approx(sorted(v for *_, v in plain))
    assert len({f for f, *_ in want.values()}) > 8
    assert layers.coarsen(df.limit(0), 7).count() == 0


def test_layers_average_over_the_years_that_hold_each_month(spark):
    days = harmonize.date_spine(spark.createDataFrame([(1,), (2,)], "area int"), CFG.coarse_start, CFG.record_end)
    got = {r["layer"]: r["years"] for r in layers.layer_years(days).collect()}
    assert [got[m] for m in ("m01", "m10", "m11", "m12")] == [24, 24, 25, 25]
    assert got["all"] == pytest.approx(24.17, abs=0.01) and len(got) == 13


def test_counting_first_equals_valuing_every_row(spark):
    rng = np.random.default_rng(2)
    cfg = CFG.with_(record_end=dt.date(2013, 12, 31))
    n = 3000
    pdf = pd.DataFrame({
        "area": rng.integers(1, 3, n), "d": (pd.Timestamp("2001-06-01") + pd.to_timedelta(rng.integers(0, 4900, n), "D")).date,
        "yi": rng.integers(0, 3, n), "xi": rng.integers(95, 105, n), "s": rng.integers(0, 3, n)}).drop_duplicates()
    g = spark.createDataFrame(pdf).select("area", "d", F.col("yi").cast("int"), F.col("xi").cast("int"), F.col("s").cast("int"))
    d0 = dt.date(2013, 2, 2)
    cal = no_outages(spark).unionByName(spark.createDataFrame(
        [(dt.date(2001, 7, 1), False, True, False, True), (d0, True, False, False, False), (dt.date(2003, 3, 3), False, False, True, False)],
        "d date, fine_out boolean, coarse_out boolean, b_out boolean, unknown boolean"))
    strips = no_strips(spark).unionByName(spark.createDataFrame([(dt.date(2013, 5, 5), 1)], "d date, band int"))
    ratios = spark.createDataFrame([(a, 1, 2.0 * a, 5.0 * a) for a in (1, 2)], "area int, mon int, k_area double, kt_area double")
    scale = spark.createDataFrame([(1, 2001, 7, 1.5)], "area int, y int, mon int, scale double")
    rows = layers.fine_equivalent(g, cal, strips, ratios, scale, cfg)
    want = rows.groupBy("area", F.year("d").alias("y"), F.month("d").alias("mon"), "xi", "yi").agg(F.sum("val").alias("val")).filter("val > 0")
    got = layers.cell_months(g, cal, strips, ratios, scale, cfg)
    key = ["area", "y", "mon", "xi", "yi"]
    a, b = got.orderBy(*key).toPandas(), want.orderBy(*key).toPandas()
    assert len(a) == len(b) > 500 and np.allclose(a.val, b.val)
    years = spark.createDataFrame([("all", 2.0), ("m07", 2.0)], "layer string, years double")
    al = layers.area_layers(got, years).toPandas()
    assert al[al.layer == "all"].val.sum() * 2 == pytest.approx(a.val.sum())
    assert al[al.layer == "y2013"].val.sum() == pytest.approx(a[a.y == 2013].val.sum())
    assert al[al.layer == "m07"].val.sum() * 2 == pytest.approx(a[a.mon == 7].val.sum())
    top = layers.multi_area_max(layers.area_layers(got, years)).filter("layer = 'all'").toPandas()
    assert len(top) == al[al.layer == "all"].groupby(["xi", "yi"]).ngroups
    assert np.allclose(top.sort_values(["xi", "yi"]).val, al[al.layer == "all"].groupby(["xi", "yi"]).val.max().sort_index())


def test_packed_tiles_decode_to_the_merged_cell_days(spark):
    rng = np.random.default_rng(6)
    n = 6000
    pdf = pd.DataFrame({
        "area": rng.integers(1, 4, n), "d": (pd.Timestamp("2011-11-01") + pd.to_timedelta(rng.integers(0, 800, n), "D")).date,
        "yi": rng.integers(-45, 30, n), "xi": rng.integers(-30, 45, n), "s": rng.integers(0, 3, n)})
    g = spark.createDataFrame(pdf).select("area", "d", F.col("yi").cast("int"), F.col("xi").cast("int"), F.col("s").cast("int"))
    packs = tiles.tile_delta_encode(g, CFG)
    back = tiles.tile_delta_decode(packs, CFG)
    merged = g.select("d", "yi", "xi", "s").distinct()
    assert back.exceptAll(merged).count() == 0 and back.count() == merged.count()
    first = packs.orderBy("ty", "tx", "s", "y").first()
    assert first["n"] == len(first["steps"]) == len(first["places"]) and min(first["steps"]) >= 0
    box = (-1.25, -2.0, 3.3, 1.05)
    want = {(r["d"], r["s"]): r["cells"] for r in grid.scan_grid(merged, bbox=box).groupBy("d", "s").agg(F.count("*").alias("cells")).collect()}
    assert {(r["d"], r["s"]): r["cells"] for r in tiles.decoded_daily(packs, box, CFG).collect()} == want


def test_viewport_takes_the_grid_cells_or_one_square_more(spark):
    df = spark.createDataFrame([(x, y, 1.0) for x in range(-5, 6) for y in range(-5, 6)], "xi int, yi int, val double")
    box = (-0.1, -0.2, 0.25, 0.2)
    exact = {(r["xi"], r["yi"]) for r in layers.viewport_cells(df, box, CFG).collect()}
    assert exact == {(x, y) for x in range(-1, 3) for y in range(-2, 2)}
    wide = {(r["xi"], r["yi"]) for r in layers.viewport_cells(df, box, CFG, margin=True).collect()}
    assert exact < wide and max(x for x, _ in wide) == 3
