"""Calendar edge cases on hand-made mean years."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from embergrid import Config
from embergrid.operators import calendar, seasons

CFG = Config()
KEYS = [d.strftime("%m-%d") for d in pd.date_range("2001-01-01", "2001-12-31")]
DOY = np.arange(365)


def clim(spark, curves):
    rows = [(a, k, float(v)) for a, curve in curves.items() for k, v in zip(KEYS, curve)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["area", "key", "mean"])).selectExpr("cast(area as int) area", "key", "mean")


def starts(spark, curves):
    areas = spark.createDataFrame([(a,) for a in curves] + [(999,)], "area int")
    return {r[0]: r[1] for r in seasons.season_start(clim(spark, curves), areas, CFG).collect()}


def plain_start(mean):
    """Straightforward reading of the rule."""
    n, w = 365, 30
    sums = np.array([round(sum(mean[(i + j) % n] for j in range(-w, w + 1)), 9) for i in range(n)])
    low = sums == sums.min()
    if low.all():
        return KEYS[0]
    f = next(i for i in range(n) if not low[i])
    best, run = (0, None), []
    for i in [(f + 1 + j) % n for j in range(n)] + [f]:
        if low[i]:
            run.append(i)
        else:
            if len(run) > best[0]:
                best = (len(run), run[(len(run) - 1) // 2])
            run = []
    return KEYS[best[1]]


def test_season_start_cases(spark):
    ridge = lambda top, half, height: np.maximum(0, height * (1 - np.abs((DOY - top + 182) % 365 - 182) / half))
    double = ridge(75, 70, 12.0) + ridge(255, 55, 30.0) + 0.5
    block = np.zeros(365)
    block[200:310] = 4.0
    two = np.zeros(365)
    two[[40, 222]] = 7.0
    curves = {1: double, 2: block, 3: np.zeros(365), 4: two}
    curves.update({10 + i: double * (1 + 0.04 * np.sin(DOY * (i + 1) / 3.7)) for i in range(12)})
    got = starts(spark, curves)
    assert got[2] == "03-14"  # the middle of the days whose 61-day window holds no fire: 7 December to 19 June
    assert got[3] == "01-01" and got[999] == "01-01"
    a = pd.Timestamp(f"2001-{got[1]}")
    for i in range(12):
        gap = abs((a - pd.Timestamp(f"2001-{got[10 + i]}")).days)
        assert min(gap, 365 - gap) <= 21
    for area, curve in curves.items():
        assert got[area] == plain_start(curve), area


def test_one_year_label_when_the_season_starts_by_19_january(spark):
    df = spark.createDataFrame([("01-19",), ("01-20",), ("07-01",)], "k string").selectExpr("k", "to_date('2003-' || k) a")
    got = [r[0] for r in df.select(seasons.season_label(df["a"], df["k"])).collect()]
    assert got == ["2003", "2003–04", "2003–04"]


def test_whole_seasons_only_and_leap_days(spark):
    cfg = CFG.with_(coarse_start=dt.date(2003, 1, 1), record_end=dt.date(2006, 12, 31))
    days = pd.date_range(cfg.coarse_start, cfg.record_end)
    s = spark.createDataFrame(pd.DataFrame({"area": 1, "d": days.date, "h": 1.0, "h7": 1.0})).selectExpr("cast(area as int) area", "d", "h", "h7")
    st = spark.createDataFrame([(1, "03-01")], "area int, season_start string")
    rows = {r["start_year"]: r for r in seasons.season_timing(seasons.season_assign(s, st, cfg), cfg).collect()}
    assert set(rows) == {2003, 2004, 2005} and rows[2003]["total"] == 366 and rows[2004]["total"] == 365
    assert rows[2004]["start_off"] == 36 and rows[2004]["peak_off"] == 0 and rows[2004]["end_off"] == 328  # ties: first day
    axis = seasons.season_axis(st, dt.date(2024, 2, 29)).orderBy("off").collect()
    assert [r["mon"] for r in axis] == [3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 1, 2] and axis[0]["off"] == 0
    assert axis[0]["today_off"] == (dt.date(2024, 2, 29) - dt.date(2023, 3, 1)).days


def test_leap_day_folds_into_28_february_before_the_years_are_compared(spark):
    cfg = CFG.with_(coarse_start=dt.date(2002, 1, 1), record_end=dt.date(2004, 12, 31))
    days = pd.date_range(cfg.coarse_start, cfg.record_end)
    h7 = np.where((days.month == 2) & (days.day == 29), 9.0, np.where((days.month == 2) & (days.day == 28), 3.0, 0.0))
    s = spark.createDataFrame(pd.DataFrame({"area": 1, "d": days.date, "h7": h7}))
    r = calendar.doy_climatology(s, cfg).filter("key = '02-28'").first()
    assert r["mean"] == pytest.approx((3.0 + 6.0) / 2)  # 2003: 3, 2004: (3 + 9) / 2


def test_busiest_weeks_prefer_the_earlier_of_equals(spark):
    flat = np.ones(365)
    got = [r["week"] for r in seasons.top_weeks(clim(spark, {1: flat}), CFG).orderBy("rank").collect()]
    assert got == ["01 Jan", "22 Jan", "12 Feb", "05 Mar"]
    lone = np.zeros(365)
    lone[0] = 4.0
    got = [r["week"] for r in seasons.top_weeks(clim(spark, {1: lone}), CFG).orderBy("rank").collect()]
    assert got == ["01 Jan"]  # every other week with fire is within 3 weeks, around New Year too


def test_outlook_steps_from_today(spark):
    mean = np.where(DOY < 31, 1.0, 0.0)  # burns in January only
    r = calendar.outlook(clim(spark, {1: mean}), dt.date(2024, 1, 31)).first()
    assert (r["past"], r["next"], r["change_pct"]) == (30.0, 0.0, -100.0)
