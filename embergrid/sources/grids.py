"""The cell-day table at rest: one folder per area, rows in (d, yi, xi) order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TYPES = {"d": "date", "yi": "smallint", "xi": "smallint", "s": "tinyint", "n": "int", "frp": "float"}


def write_grid(grid: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 20_000_000) -> None:
    """Sorted Parquet, zstd, partitioned by area.

    The exchange is a range on (area, d): a huge area spreads over many tasks and files instead of one,
    a small one still gets a single file, and row groups cover narrow date ranges for skipping.
    """
    typed = grid.select("area", *[F.col(c).cast(t).alias(c) for c, t in TYPES.items()])
    (
        typed.repartitionByRange("area", "d")
        .sortWithinPartitions("area", "d", "yi", "xi")
        .write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("area")
        .parquet(path)
    )


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_with_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Rows with the area taken from the path of the file that holds them."""
    area = F.regexp_extract(F.col("_metadata.file_path"), r"/area=([^/]+)/", 1)
    return spark.read.parquet(path).select(*TYPES, area.alias("area")).withColumn("area", F.col("area").cast("int"))


def write_build_record(records: DataFrame, raw_files: DataFrame, path: str) -> None:
    """(area, archive_through, raw_files): what each area was built from (a name list per area)."""
    names = raw_files.groupBy("area").agg(F.sort_array(F.collect_set("file")).alias("raw_files"))
    records.join(names, "area", "left").write.parquet(path)
