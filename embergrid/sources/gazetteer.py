"""Towns from a tab-separated gazetteer with region and country lookups, and published place tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _tsv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(columns))
    return (
        spark.read.schema(schema).option("sep", "\t").option("quote", "").option("comment", "#").csv(path)
    )


def read_places(spark: SparkSession, towns: str, regions: str, countries: str) -> DataFrame:
    """(place_id, name, lat, lon, cc, country, region, pop).

    Columns of the town file by position: 0 id, 1 name, 4 latitude, 5 longitude, 8 country code,
    10 first-level region code, 14 population. Lookups are left joins; a missing region is "".
    """
    t = _tsv(spark, towns, 19)
    region = _tsv(spark, regions, 4).select(F.col("c0").alias("region_key"), F.col("c1").alias("region"))
    country = _tsv(spark, countries, 19).select(F.col("c0").alias("cc"), F.col("c4").alias("country"))
    base = t.select(
        F.col("c0").cast("bigint").alias("place_id"), F.col("c1").alias("name"),
        F.col("c4").cast("double").alias("lat"), F.col("c5").cast("double").alias("lon"), F.col("c8").alias("cc"),
        F.concat_ws(".", "c8", "c10").alias("region_key"),
        F.coalesce(F.col("c14").cast("bigint"), F.lit(0)).alias("pop"),
    )
    return (
        base.join(region, "region_key", "left").join(country, "cc", "left")
        .select("place_id", "name", "lat", "lon", "cc", F.coalesce("country", "cc").alias("country"),
                F.coalesce("region", F.lit("")).alias("region"), "pop")
    )


def write_place_tiles(candidates: DataFrame, path: str) -> None:
    """Places per tile, biggest first, one folder per latitude row."""
    candidates.repartitionByRange("ty", "tx").sortWithinPartitions("ty", "tx", F.col("pop").desc()).write.partitionBy(
        "ty"
    ).json(path)


def read_place_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Published tiles <ty>_<tx>.json -> (ty, tx, name, lat, lon, region, cc, pop).

    A tile lists regions ``a``, country codes ``c`` and places ``p`` as mixed arrays
    [name, lat*1000, lon*1000, region index, country index, population].
    """
    raw = spark.read.schema("a array<string>, c array<string>, p array<array<string>>").json(path)
    key = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)_(\d+)\.json$", 1)
    tx = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)_(\d+)\.json$", 2)
    rows = raw.select(key.cast("int").alias("ty"), tx.cast("int").alias("tx"), "a", "c", F.explode("p").alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    return rows.select(
        "ty", "tx", at(0).alias("name"), (at(1).cast("double") / 1000).alias("lat"), (at(2).cast("double") / 1000).alias("lon"),
        F.get("a", at(3).cast("int")).alias("region"), F.get("c", at(4).cast("int")).alias("cc"), at(5).cast("bigint").alias("pop"),
    )
