"""Registered queries: SQL parses, Spark equals SQL on the smallest tables, plans stay clean."""

import os

import duckdb
import pytest

from embergrid.plans import queries as registry
from embergrid.plans.workspace import Workspace
from tools.check import TABLES, norm

DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "grid_daily", "merged_daily_fast", "static_cells", "export_daily_csv", "fit_ratios", "cross_validate", "pooled_prior",
    "season_timing", "layer_scale", "tile_delta_encode", "point_in_area", "resolve_aoi", "nearest_place", "name_match",
    "live_area_counts", "nowcast_rank", "stream_complete_days", "read_borders", "read_places", "scan_with_provenance",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def test_every_query_has_sql_that_runs(con):
    assert set(registry.QUERIES) == set(registry.SQL)
    for name, text in registry.SQL.items():
        con.execute(text).fetchall()


@pytest.mark.parametrize("name", SAMPLE)
def test_spark_equals_sql(spark, con, name):
    got, want = norm(registry.QUERIES[name](spark, DIR).toPandas()), norm(con.execute(registry.SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.equals(want)


def test_plans_have_no_python_rows_and_no_cartesian_product(spark):
    w = Workspace(spark, DIR)
    frames = [w.grid_lazy, w.static, w.daily_lazy, w.series_lazy, w.r2, w.cv_median, w.unusual, w.assigned,
              w.published_lazy, w.live_masked, w.links(w.live)]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        for node in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
            assert node not in plan


def test_detections_cross_the_network_once(spark):
    plan = Workspace(spark, DIR).grid_lazy._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan
    assert "PushedFilters: [IsNotNull(l_suppkey)" in plan and "l_orderkey" not in plan


def test_scan_of_the_grid_prunes_areas_and_pushes_the_box(spark):
    from embergrid.plans import roundtrips

    plan = roundtrips.scanned_grid(Workspace(spark, DIR), [3, 7], registry.BOX)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [area" in plan and "GreaterThanOrEqual(yi" in plan and "LessThanOrEqual(xi" in plan


def test_boxes_read_only_the_folders_of_the_areas_they_touch(spark):
    w = Workspace(spark, DIR)
    from embergrid.operators import boxes

    box = spark.createDataFrame([(1, -0.2, -0.2, 0.1, 0.1)], "aoi_id int, w double, s double, e double, n double")
    touches = spark.createDataFrame([(1, 3), (1, 7)], "aoi_id int, area int")
    found = boxes.box_cell_days(w.grid_at_rest, box, touches, w.base)
    assert found.count() == w.grid.filter("area in (3, 7) and yi between -2 and 0 and xi between -2 and 0").groupBy("d", "yi", "xi", "s").count().count()
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    rows = found._jdf.queryExecution()
    found.collect()
    scans = [line for line in rows.executedPlan().toString().splitlines() if "grid_at_rest" in line]
    assert scans and all("dynamicpruning" in line or "PartitionFilters" in line for line in scans)


def test_small_queries_return_rows(spark):
    for name in ("recent_unusual", "unusual_months", "box_touches_extent", "load_outages", "join_feeds"):
        assert registry.QUERIES[name](spark, DIR).limit(1).count() == 1, name


@pytest.mark.parametrize("name", ["box_daily", "box_series", "nowcast_rank_boxes", "scan_grid_boxes"])
def test_cell_days_are_read_once_for_boxes_that_see_the_same(spark, con, monkeypatch, name):
    from embergrid.operators import boxes

    drawn, plain = [], boxes.box_cell_days
    monkeypatch.setattr(boxes, "box_cell_days", lambda cells, some, *rest: drawn.append(some.count()) or plain(cells, some, *rest))
    got, want = norm(registry.QUERIES[name](spark, DIR).toPandas()), norm(con.execute(registry.SQL[name]).df())
    assert got.equals(want) and len(got) > 0
    assert len(drawn) == 1 and drawn[0] < Workspace(spark, DIR).boxes.count() * 0.7
