"""One nested document per area, assembled from the tidy result tables.

Arrays hold at most one entry per day, month or season of the record, so a document is bounded by the
calendar however many detections an area has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from embergrid.functions.numbers import half_even


def _rows(table: DataFrame, name: str, *columns) -> DataFrame:
    """(area, name): the table's rows per area as a sorted array of structs."""
    return table.groupBy("area").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def analysis_document(
    areas: DataFrame, smoothed: DataFrame, anomalies: DataFrame, unusual: DataFrame, climatology: DataFrame,
    starts: DataFrame, seasons: DataFrame, critical: DataFrame, weeks: DataFrame, yearly: DataFrame, reliability: DataFrame,
) -> DataFrame:
    """(area, document): JSON text with the series, calendar, seasons and skill of an area."""
    h = lambda c, nd: half_even(F.col(c), nd).alias(c)
    parts = [
        smoothed.groupBy("area").agg(half_even(F.sum("h"), 0).alias("total_cell_days")),
        _rows(smoothed, "daily", "d", h("m", 1), h("v", 1), h("h", 2), h("h7", 2)),
        _rows(anomalies, "monthly", "y", "mon", half_even(F.col("x"), 1).alias("value"), h("z", 2)),
        _rows(unusual, "unusual", "rank", "y", "mon", "z", "value", "normal"),
        _rows(climatology, "climatology", "key", h("mean", 2), h("p10", 2), h("p50", 2), h("p90", 2)),
        starts,
        _rows(seasons, "seasons", "start_year", "label", "total", "start", "peak", "end", "length", "z"),
        critical.select("area", F.struct("start", "peak", "end", "length").alias("critical")),
        _rows(weeks, "top_weeks", "rank", "week"),
        _rows(yearly, "yearly", "y", "m", "v", "h"),
        reliability.select(
            "area", F.struct("overlap_cell_days", "r2_monthly", "cv_median_ape", "low_counts", "issues").alias("skill")
        ),
    ]
    doc = areas.select("area")
    for part in parts:
        doc = doc.join(part, "area", "left")
    body: list[Column] = [F.col(c) for c in doc.columns if c != "area"]
    return doc.select("area", F.to_json(F.struct(F.col("area"), *body)).alias("document"))


def document_summary(documents: DataFrame) -> DataFrame:
    at = lambda path: F.get_json_object("document", path)
    length = lambda path: F.coalesce(F.json_array_length(at(path)), F.lit(0)).cast("bigint")
    return documents.select(
        "area", at("$.total_cell_days").cast("double").alias("total_cell_days"), length("$.monthly").alias("months"),
        length("$.seasons").alias("seasons"), at("$.season_start").alias("season_start"),
    )
