"""Positions of pattern matches as column expressions: arrays of (start, end, value) in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NO_SPANS = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches of a Java pattern that never matches the empty string.

    A text is the alternation of the pieces between the matches and the matches, so positions are running sums of
    their lengths.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.struct(F.length(b).alias("skip"), f.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(NO_SPANS).alias("spans"))

    def step(done: Column, one: Column) -> Column:
        begin = done["at"] + one["skip"]
        end = begin + F.length(one["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), one["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    return F.aggregate(steps, start, step, lambda done: done["spans"])


def guarded(condition: Column, spans: Column) -> Column:
    """Spans where the cheap condition holds, none elsewhere."""
    return F.when(condition, spans).otherwise(F.array().cast(NO_SPANS))


def listing(spans: Column) -> Column:
    """kind:start:end of an array of structs with those fields, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def overlaps(one: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < one["end"]) & (one["start"] < o["end"]))
