"""Readers and writers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from embergrid import Config
from embergrid.operators import grid, layers, live, tiles
from embergrid.sources import archives, borders, gazetteer, grids, packs, prior, versions

CFG = Config()


@pytest.fixture
def raw(tmp_path):
    a, b = tmp_path / "raw" / "Alpha", tmp_path / "raw" / "Beta"
    a.mkdir(parents=True), b.mkdir(parents=True)
    (a / "coarse_2019.csv").write_text("latitude,longitude,acq_date,satellite,confidence,frp,type\n-12.37,28.91,2019-08-14,Terra,55,7.5,0\n")
    (b / "coarse_2021.csv").write_text(
        "acq_date,longitude,latitude,brightness,satellite,frp,confidence,type\n2021-06-30,101.22,3.08,311.7,Aqua,4.25,64,0\n")
    (a / "fine_2021.csv").write_text("latitude,longitude,acq_date,confidence,frp,type\n-12.36,28.93,2021-08-15,h,9.5,0\n")
    return tmp_path / "raw"


def test_archives_are_united_by_column_name(spark, raw):
    coarse = archives.read_coarse_archive(spark, [f"{raw}/*/coarse_*.csv"])
    got = {r["area"]: r for r in coarse.collect()}
    assert got["Beta"]["latitude"] == 3.08 and got["Beta"]["confidence"] == 64 and got["Beta"]["satellite"] == "Aqua"
    assert got["Alpha"]["acq_date"] == dt.date(2019, 8, 14) and "brightness" not in coarse.columns
    fine = archives.read_fine_archive(spark, [f"{raw}/*/fine_*.csv"])
    g = grid.grid_daily(archives.as_detections(coarse, fine, CFG), CFG)
    cells = {(r["area"], r["yi"], r["xi"], r["s"]) for r in g.collect()}
    assert cells == {("Alpha", -124, 289, 0), ("Alpha", -124, 289, 2), ("Alpha", -124, 289, 1), ("Beta", 30, 1012, 0)}
    rec = {r["area"]: r["archive_through"] for r in grid.build_record(archives.as_detections(coarse, fine, CFG), CFG).collect()}
    assert rec == {"Alpha": 2019, "Beta": 2021}
    files = spark.createDataFrame([("Alpha", "b.csv"), ("Alpha", "a.csv")], "area string, file string")
    grids.write_build_record(grid.build_record(archives.as_detections(coarse, fine, CFG), CFG), files, f"{raw}/record")
    back = {r["area"]: r["raw_files"] for r in spark.read.parquet(f"{raw}/record").collect()}
    assert back["Alpha"] == ["a.csv", "b.csv"]


def test_live_feed_needs_its_columns_and_keeps_times_as_text(spark, tmp_path):
    # fixed values: the header of the external format
    head = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight"
    (tmp_path / "feed.csv").write_text(head + "\n-0.07,-0.02,341.6,0.52,0.71,2027-02-11,0812,X,Y,nominal,a,301.9,12.75,N\n"
                                       "0.08,0.03,318.4,0.47,0.63,2027-02-11,1127,X,Y,low,a,288.3,6.5,N\n")
    f = archives.read_live_feed(spark, str(tmp_path / "feed.csv"))
    assert [tuple(r)[1:3] for r in live.live_cell_days(f, CFG).collect()] == [(-1, -1)]
    assert live.live_latest(f).first()[0] == "2027-02-11 1127"
    (tmp_path / "bad.csv").write_text("latitude,longitude,acq_date,confidence,frp\n1,2,2026-10-01,n,3\n")
    with pytest.raises(ValueError, match="acq_time"):
        archives.read_live_feed(spark, str(tmp_path / "bad.csv"))


def test_feed_and_archive_files_are_read_each_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "a feed"
    folder.mkdir()
    (folder / "one.csv").write_text("latitude,longitude,acq_date,acq_time,confidence,frp\n1,2,2027-01-01,0001,n,1\n")
    (folder / "two.csv").write_text("longitude,latitude,acq_date,acq_time,confidence,frp\r\n2,1,2027-01-01,0002,n,1\r\n")
    (folder / "three.csv").write_text("\ufefffrp,acq_time,extra,acq_date,confidence,longitude,latitude\n1,0003,x,2027-01-01,n,2,1\n", encoding="utf-8")
    got = sorted((r["hhmm"], r["latitude"], r["longitude"]) for r in archives.read_live_feed(spark, str(folder)).collect())
    assert got == [("0001", 1.0, 2.0), ("0002", 1.0, 2.0), ("0003", 1.0, 2.0)]
    (folder / "four.csv").write_text("1,2,2027-01-01,0001,n,1\n")
    with pytest.raises(ValueError, match="no header line"):
        archives.read_live_feed(spark, str(folder))


def test_borders_from_a_collection_with_parts_and_holes(spark, tmp_path):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": "A"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 4), square(1, 1, 1)]}},
        {"type": "Feature", "properties": {"id": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(10, 0, 1)], [square(-12.3456, 0, 1)]]}}]}
    (tmp_path / "b.geojson").write_text(json.dumps(fc, indent=1))
    e = borders.read_borders(spark, str(tmp_path / "b.geojson"), collection=True)
    assert {(r["area"], r["poly"], r["ring"]): r["count"] for r in e.groupBy("area", "poly", "ring").count().collect()} == {
        ("A", 0, 0): 4, ("A", 0, 1): 4, ("B", 0, 0): 4, ("B", 1, 0): 4}
    assert e.filter("area = 'B' and poly = 1").agg(F.min("x1")).first()[0] == -123456
    (tmp_path / "c.json").write_text(json.dumps([{"id": "A", "name": "Alpha", "bbox": [0, 0, 4, 4], "view": None}]))
    assert borders.read_catalogue(spark, str(tmp_path / "c.json")).first()["bbox"] == [0.0, 0.0, 4.0, 4.0]


def test_prior_document_round_trip(spark, tmp_path):
    doc = {"k_world": 2.125, "k_terra_world": 5.5, "strip_deg": 15, "viirs_gaps": ["2014-04-09"], "modis_gaps": ["2003-11-23", "2014-04-09"],
           "aqua_gaps": ["2008-09-17", "2003-11-23"], "viirs_strips": {"2021-10-05": [-7, 3]}}
    (tmp_path / "prior.json").write_text(json.dumps(doc, indent=1))
    cfg = prior.load_prior(spark, str(tmp_path / "prior.json"), CFG)
    assert (cfg.prior_k, cfg.prior_kt, cfg.strip_deg) == (2.125, 5.5, 15.0)
    cal, strips = prior.load_outages(spark, str(tmp_path / "prior.json"), cfg)
    got = {r["d"].isoformat(): (r["fine_out"], r["coarse_out"], r["b_out"], r["unknown"]) for r in cal.collect()}
    assert got == {"2014-04-09": (True, True, False, True), "2003-11-23": (False, True, False, True), "2008-09-17": (False, False, True, False)}
    assert sorted(tuple(r) for r in strips.collect()) == [(dt.date(2021, 10, 5), -7), (dt.date(2021, 10, 5), 3)]
    ratios = spark.createDataFrame([(2.5, 6.5)], "k double, kt double")
    prior.write_prior(ratios, cal, strips, str(tmp_path / "out"), cfg)
    again = prior.load_prior(spark, str(tmp_path / "out"), CFG)
    assert again.prior_k == 2.5
    cal2, strips2 = prior.load_outages(spark, str(tmp_path / "out"), cfg)
    assert cal2.exceptAll(cal).count() == 0 and strips2.exceptAll(strips).count() == 0 and cal2.count() == 3


def test_gazetteer_and_place_tiles(spark, tmp_path):
    line = lambda i, name, lat, lon, cc, adm, pop: "\t".join(
        [str(i), name, "", "", str(lat), str(lon), "", "", cc, "", adm, "", "", "", str(pop), "", "", "", ""])
    (tmp_path / "t.txt").write_text(line(1, 'Town "A"', 7.5, 4.25, "NG", "09", 5000) + "\n" + line(2, "B", -1, 2, "XX", "", "") + "\n", encoding="utf-8")
    (tmp_path / "r.txt").write_text("NG.09\tOyo\tOyo\t1\n")
    (tmp_path / "c.txt").write_text("#ISO\tx\ty\tz\tName\nNG\tNGA\t566\tNI\tNigeria\n")
    got = {r["place_id"]: r for r in gazetteer.read_places(spark, str(tmp_path / "t.txt"), str(tmp_path / "r.txt"), str(tmp_path / "c.txt")).collect()}
    assert (got[1]["name"], got[1]["region"], got[1]["country"], got[1]["pop"]) == ('Town "A"', "Oyo", "Nigeria", 5000)
    assert (got[2]["region"], got[2]["country"], got[2]["pop"]) == ("", "XX", 0)
    (tmp_path / "22_163.json").write_text('{"a":["Tas"],"c":["AU"],"p":[["Hobart",-42879,147329,0,0,254930],["Geeveston",-43163,146925,0,0,1262]]}')
    rows = gazetteer.read_place_tiles(spark, str(tmp_path / "22_163.json")).orderBy("pop").collect()
    assert tuple(rows[1]) == (22, 163, "Hobart", -42.879, 147.329, "Tas", "AU", 254930)


def test_published_results_can_be_read_back(spark, tmp_path):
    cells = spark.createDataFrame([("all", x, 3, float(x + 1)) for x in range(0, 220, 7)], "layer string, xi int, yi int, val double")
    packs.write_map_layers(cells, str(tmp_path / "map"), CFG)
    assert spark.read.json(str(tmp_path / "map/tiles")).count() == 32
    assert spark.read.json(str(tmp_path / "map/index")).agg(F.sum("cells")).first()[0] == 32
    d = dt.date(2026, 1, 1)
    feed = spark.createDataFrame([(d, "1200", 0.05, 0.05, "n", 1.0)], "acq_date date, hhmm string, latitude double, longitude double, confidence string, frp double")
    c = live.live_cell_days(feed, CFG)
    links = spark.createDataFrame([(1, 0, 0)], "area int, yi int, xi int")
    packs.write_live_outputs(c, feed, links, links, str(tmp_path / "live"), CFG)
    assert spark.read.json(str(tmp_path / "live/meta")).first()["detections"] == 1
    g = spark.createDataFrame([(1, d, 0, 0, 1)], "area int, d date, yi int, xi int, s int")
    packs.write_packed_tiles(tiles.tile_delta_encode(g, CFG), str(tmp_path / "packs"))
    assert packs.read_packed_tiles(spark, str(tmp_path / "packs")).first()["steps"] == [0]
    export = spark.createDataFrame([(1, d, 2.0, None, "VIIRS, S")], "area int, d date, coarse double, fine double, source string")
    packs.write_daily_csv(export, str(tmp_path / "csv"))
    text = next((tmp_path / "csv" / "area=1").glob("*.csv")).read_text()
    assert text == 'd,coarse,fine,source\n2026-01-01,2.0,,"VIIRS, S"\n'
    packs.write_documents(spark.createDataFrame([(1, "{}")], "area int, document string"), str(tmp_path / "docs"))
    assert layers.tile_index(c, CFG.map_tile).first()["cells"] == 1


def test_an_update_of_the_grid_writes_only_the_years_that_changed(spark, tmp_path):
    path, folder = str(tmp_path / "grid"), lambda v: {p.relative_to(tmp_path / "grid/data" / f"version={v}").as_posix() for p in (tmp_path / "grid/data" / f"version={v}").glob("area=*/y=*")}
    day = lambda y, m=5: dt.date(y, m, 3)
    schema = "area int, d date, yi int, xi int, s int, n bigint, frp double"
    old = [(a, day(y, m), a, m, 1, 2, 1.5) for a in (1, 2) for y in (2019, 2020) for m in (1, 2, 3)]
    as_set = lambda df: sorted((r["area"], r["d"], r["yi"], r["xi"], r["s"], r["n"]) for r in df.collect())
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert versions.grid_manifest(spark, path).count() == 0
    assert versions.update_grid(make(old), path) == 1
    assert versions.update_grid(make(old).repartition(5), path) == 1  # the same rows: no new version
    before = versions.read_version(spark, path)
    grown = old + [(1, day(2021), 0, 0, 0, 1, 1.0), (3, day(2020), 9, 9, 1, 1, 1.0)]
    assert versions.update_grid(make(grown), path) == 2
    assert folder(2) == {"area=1/y=2021", "area=3/y=2020"}
    assert as_set(versions.read_version(spark, path)) == sorted(r[:6] for r in grown) and as_set(before) == sorted(r[:6] for r in old)
    # an update that stopped before its manifest is not seen, and its number is used again
    (tmp_path / "grid/data/version=3/area=1/y=2019").mkdir(parents=True)
    (tmp_path / "grid/manifest/3").mkdir()
    changed = [(*r[:5], 7, 1.5) if r[:2] == (2, day(2019, 1)) else r for r in grown if r[0] != 3]
    assert versions.grid_versions(spark, path) == [1, 2] and versions.update_grid(make(changed), path) == 3
    assert folder(3) == {"area=2/y=2019"}
    assert as_set(versions.read_version(spark, path)) == sorted(r[:6] for r in changed)
    assert as_set(versions.read_version(spark, path, 2)) == sorted(r[:6] for r in grown)
    plan = versions.read_version(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    versions.forget_versions(spark, path, keep=1)
    assert versions.grid_versions(spark, path) == [3] and as_set(versions.read_version(spark, path)) == sorted(r[:6] for r in changed)
    assert sorted(p.name for p in (tmp_path / "grid/data").iterdir()) == ["version=1", "version=2", "version=3"]  # parts of all are in use
    versions.update_grid(make([(5, day(2022), 1, 1, 1, 1, 1.0)]), path)
    versions.forget_versions(spark, path, keep=1)
    assert sorted(p.name for p in (tmp_path / "grid/data").iterdir()) == ["version=4"]
