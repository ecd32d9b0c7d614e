"""Areas with a known answer: a yearly wave of fire, and a fine sensor that sees k cells for each coarse one."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

WAVE_DAYS, WAVE_TOP = 60, 24


def coarse_cells(days_, peak):
    """Cells of each day: 2 to 6 by a fixed pattern, and a triangle of two months either side of the peak day of the year."""
    away = np.abs((days_.dayofyear.to_numpy() - peak + 183) % 366 - 183)
    wave = np.maximum(0, WAVE_TOP * (1 - away / WAVE_DAYS))
    return (2 + np.arange(len(days_)) * 3 % 5 + wave).astype(int)


def make_area(spark, area, cfg, k=2.5, kt=6.0, peak=12, fine_off=(), corner=(-60, 80)):
    """Cells of the coarse sensor fill an 8-wide block at ``corner`` (row, column); those of the fine sensor another, 50 rows
    further north; platform A alone sees what kt says before the fine era, and everything after it."""
    days_ = pd.date_range(cfg.coarse_start, cfg.record_end)
    m = coarse_cells(days_, peak)
    fine = (days_ >= pd.Timestamp(cfg.fine_start)) & ~days_.isin(pd.DatetimeIndex(fine_off))
    seen = {0: m, 1: np.where(fine, np.rint(m * k), 0), 2: np.where(days_ < pd.Timestamp(cfg.fine_start), np.rint(m * k / kt), m)}
    parts = []
    for s, n in seen.items():
        n = n.astype(int)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        parts.append(pd.DataFrame({
            "d": np.repeat(days_.date, n), "yi": corner[0] + 50 * (s == 1) + nth // 8, "xi": corner[1] + nth % 8, "s": s,
        }))
    df = spark.createDataFrame(pd.concat(parts).astype({"yi": "int32", "xi": "int32", "s": "int32"}))
    return df.select(F.lit(area).alias("area"), "d", "yi", "xi", "s", F.lit(1).cast("bigint").alias("n"), F.lit(10.0).alias("frp"))


def no_outages(spark):
    return spark.createDataFrame([], "d date, fine_out boolean, coarse_out boolean, b_out boolean, unknown boolean")


def no_strips(spark):
    return spark.createDataFrame([], "d date, band int")


def days(first, last):
    return [x.date() for x in pd.date_range(first, last)]


def date(text):
    return dt.date.fromisoformat(text)
