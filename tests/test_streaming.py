"""Stream results equal batch results; late and repeated rows."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from embergrid import Config
from embergrid.operators import live
from embergrid.streaming import files as feed_files, live as stream_live, state
from embergrid.streaming.sink import latest, run_available, run_measured

CFG = Config()
SCHEMA = "det_id long, ts timestamp, latitude double, longitude double, confidence string, frp double"


def rows(first_id, start, n, step_minutes=60, conf="n"):
    t0 = pd.Timestamp(start)
    return [(first_id + i, (t0 + pd.Timedelta(minutes=step_minutes * i)).to_pydatetime(), 0.05 + 0.1 * (i % 3), -0.05, conf, 1.5) for i in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()

    def add(name, data):
        pdf = pd.DataFrame(data, columns=["det_id", "ts", "latitude", "longitude", "confidence", "frp"])
        pdf["ts"] = pdf["ts"].astype("datetime64[us]").dt.tz_localize("UTC")
        pdf.to_parquet(path / name)

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(path))

    return path, add, stream


def batch_days(spark, path):
    df = spark.read.schema(SCHEMA).parquet(str(path)).withColumn("acq_date", F.to_date("ts"))
    return {(r["d"], r["yi"], r["xi"]): r["n"] for r in live.live_cell_days(df, CFG).collect()}


def test_files_arriving_one_by_one_equal_the_batch(spark, folder):
    path, add, stream = folder
    add("a.parquet", rows(0, "2026-01-01 00:30", 40))
    add("b.parquet", rows(100, "2026-01-02 10:00", 40) + rows(200, "2026-01-02 10:00", 5, conf="low"))
    out, progress = run_available(stream_live.cell_days(stream_live.cleaned(stream(), CFG)), "update", "t-days")
    got = {(r["d"], r["yi"], r["xi"]): r["n"] for r in latest(out, "d", "yi", "xi").collect()}
    assert got == batch_days(spark, path) and len(progress) >= 2
    assert out.select("batch").distinct().count() >= 2


def test_repeated_rows_count_once(spark, folder):
    path, add, stream = folder
    add("a.parquet", rows(0, "2026-01-01", 30))
    add("b.parquet", rows(0, "2026-01-01", 30) + rows(30, "2026-01-02 06:00", 4))
    once = stream_live.deduplicated(stream_live.cleaned(stream(), CFG))
    out, _ = run_available(once.select("det_id", "ts", "yi", "xi"), "append", "t-dedupe")
    assert out.count() == 34 and out.select("det_id").distinct().count() == 34


def test_detections_older_than_the_watermark_are_dropped(spark, folder):
    path, add, stream = folder
    import os
    import time

    for i, (name, data) in enumerate((
        ("a.parquet", rows(0, "2026-01-20", 24)), ("b.parquet", rows(50, "2026-01-21", 24)), ("c.parquet", rows(100, "2026-01-01", 6))
    )):
        add(name, data)
        os.utime(path / name, (time.time() - 100 + i * 10,) * 2)
    out, progress = run_available(stream_live.cell_days(stream_live.cleaned(stream(), CFG)), "update", "t-late")
    days = {r["d"] for r in out.select("d").distinct().collect()}
    assert days == {dt.date(2026, 1, 20), dt.date(2026, 1, 21)}
    dropped = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    assert dropped > 0


def test_append_mode_shows_complete_days_only(spark, folder):
    path, add, stream = folder
    add("a.parquet", rows(0, "2026-01-01", 24 * 5))
    out, _ = run_available(stream_live.cell_days(stream_live.cleaned(stream(), CFG, "1 day")), "append", "t-complete")
    assert {r["d"].day for r in out.select("d").distinct().collect()} == {1, 2, 3}


def test_mask_and_rolling_windows(spark, folder):
    path, add, stream = folder
    add("a.parquet", rows(0, "2026-01-01", 48))
    mask = spark.createDataFrame([(0, -1)], "yi int, xi int")
    out, _ = run_available(stream_live.cell_days(stream_live.masked(stream_live.cleaned(stream(), CFG), mask)), "update", "t-mask")
    assert {r["yi"] for r in out.collect()} == {1, 2}
    days, _ = run_available(stream_live.cell_days(stream_live.cleaned(stream(), CFG)), "update", "t-weeks")
    weeks = stream_live.rolling_weeks(latest(days, "d", "yi", "xi"))
    got = {r["first_day"]: r["n"] for r in weeks.groupBy("first_day").agg(F.sum("n").alias("n")).collect()}
    assert got[dt.date(2026, 1, 1)] == 48 and got[dt.date(2025, 12, 26)] == 24 and got[dt.date(2026, 1, 2)] == 24


def test_a_stopped_stream_goes_on_without_counting_twice(spark, folder, tmp_path):
    path, add, stream = folder
    home = str(tmp_path / "home")
    run = lambda: run_available(stream_live.cell_days(stream_live.cleaned(stream(), CFG)), "update", "t-restart", home=home)
    assert run()[0].count() == 0  # nothing has come yet
    add("a.parquet", rows(0, "2026-01-01 00:30", 40))
    run()
    add("b.parquet", rows(100, "2026-01-02 10:00", 40))
    out, progress = run()
    assert sum(p["numInputRows"] for p in progress) == 40  # the first file is not read again
    got = {(r["d"], r["yi"], r["xi"]): r["n"] for r in latest(out, "d", "yi", "xi").collect()}
    assert got == batch_days(spark, path)


def plain_weeks(spark, path, complete_before=None):
    df = spark.read.schema(SCHEMA).parquet(str(path)).withColumn("acq_date", F.to_date("ts"))
    weeks = {}
    for r in live.live_cell_days(df, CFG).collect():
        for back in range(7):
            key = (r["d"] - dt.timedelta(back), r["yi"], r["xi"])
            weeks[key] = weeks.get(key, 0) + r["n"]
    return {k: n for k, n in weeks.items() if complete_before is None or k[0] + dt.timedelta(7) <= complete_before}


def test_sliding_weeks_come_out_of_the_stream_and_go_on_after_a_stop(spark, folder, tmp_path):
    path, add, stream = folder
    grown = lambda: run_available(stream_live.week_counts(stream_live.cleaned(stream(), CFG)), "update", "t", home=str(tmp_path / "u"))[0]
    whole = lambda: run_available(stream_live.complete_weeks(stream_live.cleaned(stream(), CFG, "1 day")), "append", "t", home=str(tmp_path / "a"))[0]
    add("a.parquet", rows(0, "2026-01-01 00:30", 100))
    first = latest(grown(), "first_day", "yi", "xi")
    assert {(r["first_day"], r["yi"], r["xi"]): r["n"] for r in first.collect()} == plain_weeks(spark, path)
    early = whole()
    assert {r["first_day"] for r in early.select("first_day").distinct().collect()} == {dt.date(2025, 12, d) for d in (26, 27, 28)}
    add("b.parquet", rows(200, "2026-01-04 12:00", 300))
    both = latest(grown(), "first_day", "yi", "xi")
    assert {(r["first_day"], r["yi"], r["xi"]): r["n"] for r in both.collect()} == plain_weeks(spark, path)
    done = whole().collect()
    got = {(r["first_day"], r["yi"], r["xi"]): r["n"] for r in done}
    assert len(got) == len(done)  # a week is emitted once
    # the last detection is of the 16th, 23:00
    assert got == plain_weeks(spark, path, dt.date(2026, 1, 15))


def test_the_window_table_opens_no_more_files_after_many_batches(spark, tmp_path):
    home, opened, want = str(tmp_path / "window"), [], {}
    for number in range(50):
        day = dt.date(2026, 1, 1) + dt.timedelta(number // 2)
        new = [(day, 1, number % 3, number + 1, 1.0), (day, 2, 2, number, 1.0)]
        want.update({r[:3]: r[3] for r in new})
        table = state.advance(home, spark.createDataFrame(new, "d date, yi int, xi int, n bigint, frp double").coalesce(1), number, 7)
        opened.append(len(table.inputFiles()))
    newest = max(d for d, *_ in want)
    assert {(r["d"], r["yi"], r["xi"]): r["n"] for r in table.collect()} == {k: n for k, n in want.items() if k[0] >= newest - dt.timedelta(7)}
    assert max(opened[10:]) <= max(opened[:10])
    # a batch that has to be repeated starts from the table before it
    held = table.count()
    again = state.advance(home, spark.createDataFrame(new, "d date, yi int, xi int, n bigint, frp double"), 49, 7)
    assert again.count() == held
    assert state.advance(str(tmp_path / "none"), again.limit(0), 0, 7) is None


def test_rows_late_repeated_and_added_are_counted_over_a_restart(spark, folder, tmp_path):
    path, add, stream = folder
    home = str(tmp_path / "late")

    def run():
        once = stream_live.deduplicated(stream_live.measured(stream_live.cleaned(stream(), CFG, "1 day")))
        return run_measured(once.select("det_id", "ts", "yi", "xi"), "append", "t-metrics", home=home)

    add("a.parquet", rows(0, "2026-01-20", 48) + rows(900, "2026-01-20", 5, conf="l"))
    _, first = run()
    assert [(r["rows"], r["late"], r["repeated"], r["added"]) for r in first.collect()] == [(48, 0, 0, 48)]
    add("b.parquet", rows(0, "2026-01-20", 48) + rows(100, "2026-01-22", 10) + rows(200, "2026-01-02", 7))
    out, table = run()
    got = [tuple(r) for r in table.orderBy("batch").select("rows", "late", "repeated", "added").collect()]
    # the watermark stands at the 20th, 23:00: that hour and all before it are late
    assert got == [(48, 0, 0, 48), (65, 24 + 7, 24, 10)]
    assert out.count() == 58 and table.orderBy(F.col("batch").desc()).first()["watermark"] == dt.datetime(2026, 1, 20, 23)
    assert run()[1].count() == 2  # nothing new: no row


def test_a_feed_file_under_another_name_adds_nothing(spark, tmp_path):
    head = "latitude,longitude,acq_date,acq_time,confidence,frp"
    body = [f"{0.05 + i / 10},-0.05,2026-05-0{1 + i % 3},{i}30,n,1.5" for i in range(6)]
    landing = tmp_path / "landing"
    landing.mkdir()
    run = lambda: run_available(feed_files.feed_rows(feed_files.new_files(spark, str(landing))), "append", "t", home=str(tmp_path / "home"))[0]
    (landing / "a.csv").write_text("\n".join([head, *body]) + "\n")
    (landing / "a_again.csv").write_text("\n".join([head, *body]) + "\n")
    assert run().count() == 6
    (landing / "restamped.csv").write_text("\n".join([head, *body]) + "\n")
    (landing / "swapped.csv").write_text("\ufefffrp,longitude,latitude,extra,acq_time,acq_date,confidence\r\n2.5,12.5,-3.5,x,5,2026-05-04,h\r\n\r\n", encoding="utf-8")
    kept = run()
    assert kept.count() == 7
    one = kept.filter("frp = 2.5").first()
    assert (one["latitude"], one["longitude"], one["hhmm"], one["acq_date"]) == (-3.5, 12.5, "5", dt.date(2026, 5, 4))
    assert run().count() == 7
    (landing / "bad.csv").write_text("latitude,longitude\n1,2\n")
    with pytest.raises(Exception, match="lacks columns"):
        run()
