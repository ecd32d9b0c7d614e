"""Calendar keys. All dates are UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def day(value: dt.date) -> Column:
    return F.lit(value).cast("date")


def day_key(d: Column) -> Column:
    """"MM-dd", with 29 February folded into 28 February."""
    k = F.date_format(d, "MM-dd")
    return F.when(k == "02-29", F.lit("02-28")).otherwise(k)


def key_date(year: Column, key: Column) -> Column:
    """The date of a folded "MM-dd" key in a year (always valid: keys never are 29 February)."""
    return F.make_date(year.cast("int"), F.substring(key, 1, 2).cast("int"), F.substring(key, 4, 2).cast("int"))


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def same_date_in(year: Column, month: Column, dom: Column) -> Column:
    """month/dom in another year; 28 February stands in for a missing 29 February."""
    fixed = F.when((month == 2) & (dom == 29) & ~is_leap(year), F.lit(28)).otherwise(dom)
    return F.make_date(year.cast("int"), month.cast("int"), fixed.cast("int"))
