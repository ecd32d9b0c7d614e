"""Grid arithmetic: cells, tiles, bands, boxes. Negative-safe throughout (floor, never truncation)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def floor_div(value: Column, size) -> Column:
    return F.floor(value / F.lit(size)).cast("int")


def cell_index(degrees: Column, cell: int) -> Column:
    """Index of the cell that holds a coordinate."""
    return F.floor(degrees * F.lit(cell)).cast("int")


def in_tile(yi: Column, xi: Column, tile: int) -> tuple[Column, Column, Column]:
    """(ty, tx, idx): the tile of a cell and the cell's row-major place inside it."""
    ty, tx = floor_div(yi, tile), floor_div(xi, tile)
    return ty, tx, ((yi - ty * tile) * tile + (xi - tx * tile)).cast("int")


def box_cells(w: Column, s: Column, e: Column, n: Column, cell: int) -> tuple[Column, Column, Column, Column]:
    """Inclusive cell bounds (y0, y1, x0, x1) of a box in degrees."""
    lo = lambda v: F.floor(v * cell).cast("int")
    hi = lambda v: (F.ceil(v * cell) - 1).cast("int")
    return lo(s), hi(n), lo(w), hi(e)


def wrap_degrees(delta: Column) -> Column:
    """Longitude difference the short way round, in [-180, 180)."""
    return F.pmod(delta + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)
