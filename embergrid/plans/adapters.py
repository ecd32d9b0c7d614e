"""Detections, live feed, borders, places and boxes derived from the TPC-H-like tables.

The operators know nothing of these tables; this module maps them to the operators' input schemas.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from embergrid.config import Config

# Eras, thresholds and priors that suit the tables' dates (1995-2001) and density.
TABLE_CONFIG = Config(
    coarse_start=dt.date(1995, 1, 1),
    platform_b_start=dt.date(1995, 7, 4),
    fine_start=dt.date(1997, 1, 20),
    drift_from=dt.date(2000, 1, 1),
    check_from=dt.date(1996, 1, 1),
    prior_k=0.6,
    prior_kt=1.2,
    gap_min_coarse=5,
    strip_min_coarse=2,
    strip_deg=0.2,
    min_overlap=100,
    static_min=2,
    static_weight=8.0,
    wide_span_deg=0.5,
    unusual_z=1.5,  # among five complete years no sample z exceeds 1.79
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, cfg: Config = TABLE_CONFIG) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_shipdate", "l_returnflag", "l_quantity", "l_linenumber", "l_extendedprice"
    )
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    flag = F.col("l_returnflag")
    raw = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("area"),
        F.col("l_shipdate").cast("date").alias("acq_date"),
        ((F.col("l_partkey") % 16) * F.lit(0.05) - F.lit(0.4)).alias("latitude"),
        ((F.col("l_partkey") % 14) * F.lit(0.05) - F.lit(0.3)).alias("longitude"),
        F.when(flag == "N", "F").otherwise("C").alias("instrument"),
        F.when(flag == "A", "P1").when(flag == "R", "P2").otherwise("F1").alias("satellite"),
        (F.col("l_quantity") * 2).cast("int").alias("conf_pct"),
        F.when(F.col("l_linenumber") == 1, "l").when(F.col("l_linenumber") <= 4, "n").otherwise("h").alias("conf_cls"),
        F.when(F.col("l_partkey") % 17 == 0, 2).otherwise(0).alias("type"),
        F.col("l_extendedprice").alias("frp"),
    )
    coarse = (F.col("instrument") == "C") & (
        (F.col("satellite") == "P1") | (F.col("acq_date") >= F.lit(cfg.platform_b_start))
    )
    fine = (F.col("instrument") == "F") & (F.col("acq_date") >= F.lit(cfg.fine_start))
    return raw.filter(coarse | fine)


def as_feed(events: DataFrame) -> DataFrame:
    """Events as live detections; ``ts`` stays for streaming and for splitting feeds."""
    kind = F.col("event_type")
    ts = F.col("ts")
    return events.select(
        ts.cast("date").alias("acq_date"),
        (F.hour(ts) * 100 + F.minute(ts)).alias("hhmm"),
        ((F.col("user_id") % 16) * F.lit(0.05) - F.lit(0.4)).alias("latitude"),
        ((F.col("user_id") % 14) * F.lit(0.05) - F.lit(0.3)).alias("longitude"),
        F.when(kind == "error", "l").when(kind == "view", "nominal").when(kind == "purchase", "high")
        .when(kind == "click", "n").otherwise("h").alias("confidence"),
        F.col("value").alias("frp"),
        F.col("event_id").alias("det_id"),
        "ts",
    )


FEED_HOURS = 168  # a feed reaches back so far from its newest detection
SITE_LAG_HOURS = 36  # the published copy of the feed is older by this
FRESH_HOURS = 54  # the short, newer feed


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(newest): time of the last event, one row."""
    return read(spark, sf_dir, "events").agg(F.max("ts").alias("newest"))


def live(spark: SparkSession, sf_dir: str, hours: int = FEED_HOURS, lag_hours: int = 0) -> DataFrame:
    """The feed as it stands ``lag_hours`` before the newest event, reaching back ``hours`` from the newest one."""
    feed = as_feed(read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    dated = feed.crossJoin(F.broadcast(newest(spark, sf_dir)))  # one row
    before = lambda h: F.col("newest") - F.expr(f"INTERVAL {h} HOURS")
    return dated.filter((F.col("ts") >= before(hours)) & (F.col("ts") <= before(lag_hours))).drop("newest")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known area; ``ready`` areas have been processed."""
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("area"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 4 != 1).alias("ready")
    )


def border_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds on a 5 x 5 lattice; even areas have a hole, every fifth area has no border."""
    key = F.col("n_nationkey").cast("bigint")
    rings = F.array(
        F.struct(F.lit(0).alias("ring"), F.lit(1600).cast("bigint").alias("r")),
        F.when(F.col("n_nationkey") % 2 == 0, F.struct(F.lit(1).alias("ring"), F.lit(400).cast("bigint").alias("r"))),
    )
    c = read(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 5 != 4).select(
        F.col("n_nationkey").alias("area"), F.lit(0).alias("poly"),
        ((key % 5) * 1500 - 3000).alias("cx"), (F.floor(key / 5) * 1500 - 3000).alias("cy"),
        F.inline(F.array_compact(rings)),
    )
    q = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    sign = lambda plus, minus: F.when(F.col("k") == plus, 1).when(F.col("k") == minus, -1).otherwise(0)
    at = lambda mid, plus, minus: F.col(mid) + F.col("r") * sign(plus, minus)
    return q.select(
        "area", "poly", "ring",
        at("cx", 0, 2).alias("x1"), at("cy", 1, 3).alias("y1"), at("cx", 3, 1).alias("x2"), at("cy", 0, 2).alias("y2"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier")
    nation = read(spark, sf_dir, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("place_id"),
        F.col("s_name").alias("name"),
        ((F.col("s_suppkey") % 16) * F.lit(0.05) - F.lit(0.387)).alias("lat"),
        ((F.col("s_suppkey") % 14) * F.lit(0.05) - F.lit(0.281)).alias("lon"),
        (1000 + F.floor(F.abs("s_acctbal") * 10)).alias("pop"),
        F.col("n_name").alias("region"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn box per customer."""
    k = F.col("c_custkey")
    w = (k % 37) * F.lit(0.05) - F.lit(0.9)
    s = (k % 23) * F.lit(0.05) - F.lit(0.6)
    return read(spark, sf_dir, "customer").select(
        k.alias("aoi_id"), w.alias("w"), s.alias("s"),
        (w + F.lit(0.02) + (k % 5) * F.lit(0.1)).alias("e"), (s + F.lit(0.03) + (k % 7) * F.lit(0.05)).alias("n"),
    )


def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as typed: some reach over the globe's edge, some are empty, some too large."""
    k = F.col("c_custkey")
    w = (k % 41) * F.lit(10.03) - F.lit(205.5)
    s = (k % 29) * F.lit(7.017) - F.lit(100.25)
    return read(spark, sf_dir, "customer").select(
        k.alias("aoi_id"), w.alias("w"), s.alias("s"),
        (w + (k % 13) * F.lit(8.5) - F.lit(5.0)).alias("e"), (s + (k % 11) * F.lit(9.25) - F.lit(4.0)).alias("n"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border features with several name columns, accents and spelling variants."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    accented = F.regexp_replace(F.initcap(F.regexp_replace(name, "_", " ")), "Nation", "Nátîon")
    return read(spark, sf_dir, "nation").select(
        k.alias("feature_id"),
        F.when(k % 3 == 0, F.upper(accented)).alias("admin"),
        F.when(k % 3 != 2, accented).alias("name_long"),
        F.when(k % 5 != 4, name).alias("short_name"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "nation")
        .filter("n_nationkey % 7 = 6")
        .select(F.col("n_nationkey").alias("area"), F.concat(F.lit("nation "), (F.col("n_nationkey") - 1).cast("string")).alias("alias"))
    )
