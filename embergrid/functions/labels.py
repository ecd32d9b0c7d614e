"""Text and class labels of a value: degrees, eras, statuses, reasons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from embergrid.config import Config
from embergrid.functions.numbers import half_even

# Wording of the classes an export or a report shows.
NO_RECORD = "no satellite record: the area's usual fire for the date at that month's level"
A_ONLY_OUTAGE = "MODIS Terra only × k (Aqua outage)"
A_ONLY = "MODIS Terra only × k"
COARSE = "MODIS Terra+Aqua × k"
COARSE_FOR_FINE = "MODIS Terra+Aqua × k (VIIRS outage)"
FINE_WITH_STRIP = "VIIRS S-NPP + MODIS × k where it lost an orbit"
FINE = "VIIRS S-NPP"
HISTORY_WORDS = ("rare", "occasional", "frequent", "very frequent")
LIVE_WORDS = ("few", "some", "many", "very many")
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def latitude(v: Column) -> Column:
    return F.concat(F.format_string("%.1f°", half_even(F.abs(v), 1)), F.when(v < 0, "S").otherwise("N"))


def longitude(v: Column) -> Column:
    return F.concat(F.format_string("%.1f°", half_even(F.abs(v), 1)), F.when(v < 0, "W").otherwise("E"))


def bbox_label(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.concat(latitude(s), F.lit("–"), latitude(n), F.lit(", "), longitude(w), F.lit("–"), longitude(e))


def source_label(cfg: Config) -> Column:
    """Which sensor supplied a day of a flagged series (columns d, unknown, gap, strip, b_out)."""
    a_only = F.col("b_out") & ((F.col("d") < F.lit(cfg.fine_start)) | F.col("gap"))
    return (
        F.when(F.col("unknown"), F.lit(NO_RECORD))
        .when(a_only, F.lit(A_ONLY_OUTAGE))
        .when(F.col("d") < F.lit(cfg.platform_b_start), F.lit(A_ONLY))
        .when(F.col("d") < F.lit(cfg.fine_start), F.lit(COARSE))
        .when(F.col("gap"), F.lit(COARSE_FOR_FINE))
        .when(F.col("strip"), F.lit(FINE_WITH_STRIP))
        .otherwise(F.lit(FINE))
    )


def era_tag(year: Column, cfg: Config) -> Column:
    b, f = cfg.platform_b_start.year, cfg.fine_start.year
    return (
        F.when(year < b, "T")
        .when((year < f) & (year == b), "T/A")
        .when(year < f, "T+A")
        .otherwise("V")
    )


def now_status(record: Column, percentile: Column, cfg: Config) -> Column:
    return (
        F.when(percentile.isNull(), F.lit(None).cast("string"))
        .when(record, f"Highest for these dates since {cfg.first_full}")
        .when(percentile >= 90, "Well above normal")
        .when(percentile >= 70, "Above normal")
        .when(percentile <= 10, "Well below normal")
        .otherwise("Near normal")
    )


def season_status(z: Column) -> Column:
    return (
        F.when(z.isNull(), "No data")
        .when(z >= 2, "Extreme, well above normal")
        .when(z >= 1, "Above normal")
        .when(z <= -1, "Below normal")
        .otherwise("Near normal")
    )


def confidence_issues(overlap: Column, r2: Column, cv: Column, cfg: Config) -> Column:
    """Reasons an area is indicative only, as an array in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(overlap < cfg.min_overlap, "few fires"),
            F.when(r2.isNull() | (r2 < cfg.min_r2), "noisy monthly fit"),
            F.when(cv.isNull() | (cv > cfg.max_cv), "large test error"),
        )
    )


def scale_word(value: Column, top: Column, words: tuple[str, ...]) -> Column:
    """One of ``words`` by equal parts of the layer's maximum."""
    at = F.least(F.lit(len(words)), F.floor(value / top * len(words)).cast("int") + 1)
    return F.element_at(F.array(*[F.lit(w) for w in words]), at.cast("int"))


def compass(dx: Column, dy: Column) -> Column:
    """Octant of a direction given by east and north components."""
    octant = F.rint(F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0)) / 45.0).cast("int") % 8
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), octant + 1)
