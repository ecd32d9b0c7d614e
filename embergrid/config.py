"""All tunable parameters in one frozen object; every operator takes one."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    # grid: cells per degree
    cell: int = 10

    # sensor eras (UTC calendar dates)
    coarse_start: dt.date = dt.date(2000, 11, 1)
    platform_b_start: dt.date = dt.date(2002, 7, 4)
    fine_start: dt.date = dt.date(2012, 1, 20)
    drift_from: dt.date = dt.date(2022, 1, 1)
    record_end: dt.date = dt.date(2024, 12, 31)
    check_from: dt.date = dt.date(2003, 1, 1)  # both coarse platforms fly full years from here

    # names of the sensors in the detection table
    coarse_name: str = "C"
    fine_name: str = "F"
    platform_a: str = "P1"

    # cleaning
    coarse_min_confidence: int = 30
    fine_classes: tuple[str, ...] = ("n", "h")
    live_classes: tuple[str, ...] = ("nominal", "high", "n", "h")
    vegetation_type: int = 0
    static_min: int = 20  # non-vegetation detections that make a cell industrial...
    static_weight: float = 1.0  # ...when their number times this reaches the vegetation ones

    # shrinkage, in coarse cell-days
    lam_month: float = 20.0
    lam_area: float = 50.0
    prior_k: float = 2.653
    prior_kt: float = 6.7

    # an area is "indicative only" beyond these
    min_overlap: int = 3000
    min_r2: float = 0.5
    max_cv: float = 15.0

    # outage detection
    usual_days: int = 61
    usual_min_days: int = 15
    gap_share: float = 0.25
    gap_min_coarse: int = 1000
    strip_deg: float = 10.0
    strip_share: float = 0.1
    strip_min_coarse: int = 100

    # calendar
    quiet_days: int = 61
    smooth_days: int = 7
    season_min_total: float = 5.0
    week_gap_days: int = 21
    top_weeks: int = 4
    top_unusual: int = 12
    unusual_z: float = 2.0  # a month this far from normal...
    unusual_share: float = 0.02  # ...that holds this share of a normal year...
    unusual_min: float = 1.0  # ...and at least so many cell-days

    # maps
    map_cells: int = 20000
    live_cells: int = 15000
    box_tile: int = 20
    map_tile: int = 100
    overview: int = 5
    layer_min: float = 0.05
    overview_min: float = 0.005
    wide_span_deg: float = 180.0
    max_box_deg2: float = 5000.0

    # places
    place_deg: int = 2
    place_km: float = 111.2
    place_reach_km: float = 250.0
    place_samples: int = 33

    # live feed
    live_days: int = 8

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)

    @property
    def strip_cells(self) -> float:
        """Width of an outage strip in cells."""
        return self.strip_deg * self.cell

    @property
    def overlap_from(self) -> dt.date:
        """First month the fine sensor covers whole (its start month when that starts on the 1st)."""
        s = self.fine_start
        return s if s.day == 1 else _next_month(s)

    @property
    def pooled_from(self) -> dt.date:
        """First month strictly after the fine sensor's start."""
        return _next_month(self.fine_start)

    @property
    def first_full(self) -> int:
        return self.coarse_start.year + 1

    @property
    def last_full(self) -> int:
        return self.record_end.year


def _next_month(d: dt.date) -> dt.date:
    return dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)
