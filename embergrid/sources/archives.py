"""Raw detection files: yearly archives of both sensors and the live feed."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from embergrid.config import Config

COARSE_TYPES = {
    "latitude": "double", "longitude": "double", "acq_date": "date", "satellite": "string",
    "confidence": "int", "frp": "double", "type": "int",
}
FINE_TYPES = {
    "latitude": "double", "longitude": "double", "acq_date": "date", "confidence": "string", "frp": "double", "type": "int",
}
LIVE_REQUIRED = ("latitude", "longitude", "acq_date", "acq_time", "confidence", "frp")
AREA_IN_PATH = r"/([^/]+)/[^/]+$"  # the folder a file lies in


def _headers(spark: SparkSession, paths: list[str]) -> list[tuple[str, list[str]]]:
    """Distinct header lines with their files, found by the executors: a header is the one line that names a latitude.

    What comes to the driver are names of files, which it needs to read them. A file without a header is an error: its
    rows would be lost without a word.
    """
    text = spark.read.text(paths)
    file = F.col("_metadata.file_path").alias("file")
    line = F.trim(F.regexp_replace("value", "^\ufeff|\r$", ""))
    found = text.filter(F.col("value").contains("latitude")).select(line.alias("header"), file).groupBy("file").agg(F.min("header").alias("header"))
    files: dict[str, list[str]] = {}
    for row in found.collect():
        if "latitude" in [n.strip() for n in row["header"].split(",")]:
            files.setdefault(row["header"], []).append(_plain(row["file"]))
    bare = {_plain(f) for f in text.inputFiles()} - {f for named in files.values() for f in named}
    if bare:
        raise ValueError(f"no header line with a latitude column in {', '.join(sorted(bare)[:5])}")
    return sorted((h, sorted(f)) for h, f in files.items())


def _plain(file: str) -> str:
    """One spelling of a file's address: ``file:/a`` and ``file:///a`` are the same."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(file))


def _read_by_name(spark: SparkSession, paths: list[str], types: dict[str, str], needed: tuple[str, ...] = ()) -> DataFrame:
    """Files of differing column order united by column name.

    Spark maps a user schema by position, so files are read once per distinct header.
    """
    parts = []
    for header, files in _headers(spark, paths):
        names = [n.strip() for n in header.split(",")]
        if missing := [c for c in needed if c not in names]:
            raise ValueError(f"columns missing: {', '.join(missing)} in {files[0]}")
        schema = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
        part = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(files)
        cols = [F.col(n) if n in names else F.lit(None).cast(t).alias(n) for n, t in types.items()]
        area = F.regexp_extract(F.col("_metadata.file_path"), AREA_IN_PATH, 1).alias("area")
        parts.append(part.select(*cols, area))
    if not parts:
        raise ValueError("no files given")
    return reduce(DataFrame.unionByName, parts)


def read_coarse_archive(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _read_by_name(spark, paths, COARSE_TYPES)


def read_fine_archive(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _read_by_name(spark, paths, FINE_TYPES)


def as_detections(coarse: DataFrame, fine: DataFrame, cfg: Config, platform_a: str = "Terra") -> DataFrame:
    """Both archives in the one detection schema the operators use."""
    common = ["area", "acq_date", "latitude", "longitude"]
    c = coarse.select(
        *common, F.lit(cfg.coarse_name).alias("instrument"),
        F.when(F.col("satellite") == platform_a, cfg.platform_a).otherwise("P2").alias("satellite"),
        F.col("confidence").alias("conf_pct"), F.lit(None).cast("string").alias("conf_cls"), "type", "frp",
    )
    f = fine.select(
        *common, F.lit(cfg.fine_name).alias("instrument"), F.lit("F1").alias("satellite"),
        F.lit(None).cast("int").alias("conf_pct"), F.col("confidence").alias("conf_cls"), "type", "frp",
    )
    return c.unionByName(f)


def read_live_feed(spark: SparkSession, path: str) -> DataFrame:
    """Live feed as (acq_date, hhmm, latitude, longitude, confidence, frp); times stay text. Each file is read by its own header."""
    return as_feed_rows(_read_by_name(spark, [path], {c: "string" for c in LIVE_REQUIRED}, needed=LIVE_REQUIRED))


def as_feed_rows(raw: DataFrame) -> DataFrame:
    """Text columns of a feed file in their types."""
    return raw.select(
        F.col("acq_date").cast("date").alias("acq_date"),
        F.trim("acq_time").alias("hhmm"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        F.trim("confidence").alias("confidence"),
        F.col("frp").cast("double").alias("frp"),
    )
