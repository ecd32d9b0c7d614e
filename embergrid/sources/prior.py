"""The published calibration prior with its outage days (one small JSON document)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embergrid.config import Config
from embergrid.operators.outages import with_unknown

_SCHEMA = (
    "k_world double, k_terra_world double, strip_deg double, viirs_gaps array<date>, modis_gaps array<date>, "
    "aqua_gaps array<date>, viirs_strips map<string, array<int>>"
)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(_SCHEMA).json(path)


def load_prior(spark: SparkSession, path: str, cfg: Config) -> Config:
    """Config with the published ratios (one row of scalars)."""
    row = _raw(spark, path).select("k_world", "k_terra_world", "strip_deg").first()
    return cfg.with_(prior_k=row[0], prior_kt=row[1], strip_deg=row[2] if row[2] is not None else cfg.strip_deg)


def load_outages(spark: SparkSession, path: str, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(calendar, strips): flags per affected day, and (d, band) pairs."""
    raw = _raw(spark, path)
    kinds = {"viirs_gaps": "fine_out", "modis_gaps": "coarse_out", "aqua_gaps": "b_out"}

    def tagged(column: str, kind: str):
        listed = F.coalesce(F.col(column), F.array().cast("array<date>"))
        return F.transform(listed, lambda d: F.struct(d.alias("d"), F.lit(kind).alias("k")))

    days = raw.select(F.inline(F.concat(*[tagged(c, k) for c, k in kinds.items()])))
    flags = days.groupBy("d").agg(*[F.bool_or(F.col("k") == k).alias(k) for k in kinds.values()])
    # a day the coarse record was out altogether is not a platform B outage
    calendar = flags.withColumn("b_out", F.col("b_out") & ~F.col("coarse_out"))
    strips = raw.select(F.explode("viirs_strips").alias("day", "bands")).select(
        F.col("day").cast("date").alias("d"), F.explode("bands").alias("band")
    )
    return with_unknown(calendar, cfg), strips


def write_prior(prior: DataFrame, calendar: DataFrame, strips: DataFrame, path: str, cfg: Config) -> None:
    """The same document from ``pooled_prior`` and the detected outages (all bounded by the calendar)."""
    list_of = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("d")))).alias(c)
    days = calendar.agg(list_of("fine_out"), list_of("coarse_out"), list_of("b_out")).withColumn("one", F.lit(1))
    bands = strips.groupBy("d").agg(F.array_sort(F.collect_list("band")).alias("bands")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("d").cast("string"), "bands")))).alias("strips")
    ).withColumn("one", F.lit(1))
    doc = prior.withColumn("one", F.lit(1)).join(days, "one").join(bands, "one").select(
        F.col("k").alias("k_world"), F.col("kt").alias("k_terra_world"), F.lit(cfg.strip_deg).alias("strip_deg"),
        F.col("fine_out").alias("viirs_gaps"), F.col("coarse_out").alias("modis_gaps"), F.col("b_out").alias("aqua_gaps"),
        F.col("strips").alias("viirs_strips"),
    )
    doc.write.json(path)
