"""Whole feed files as a stream: a file that only has a new name or time stamp is not new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embergrid.sources.archives import LIVE_REQUIRED, as_feed_rows

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Stream of the files below ``folder`` whose content has not been seen, by its SHA-256: path, content.

    The stream's state is the ledger: 32 bytes for every content ever accepted, kept over stops. Two files with the
    same content in one batch count once.
    """
    files = (
        spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    )
    return files.withColumn("digest", F.sha2("content", 256)).dropDuplicates(["digest"]).select("path", "content")


def feed_rows(files: DataFrame) -> DataFrame:
    """Detections of live feed files (path, content), each read by its own header line: as ``read_live_feed`` gives them.

    A file without a needed column is an error. Fields hold no quoted commas, as the feed has none; empty lines are skipped.
    """
    lines = F.split(F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff|\r", ""), "\n")
    names = F.transform(F.split(F.get("lines", F.lit(0)), ","), F.trim)
    lacking = F.array_except(F.array(*[F.lit(c) for c in LIVE_REQUIRED]), "names")
    message = F.concat(F.lit("live feed lacks columns: "), F.array_join(lacking, ", "), F.lit(" in "), F.col("path"))
    checked = (
        files.select("path", lines.alias("lines"))
        .withColumn("names", names)
        .withColumn("names", F.when(F.size(lacking) == 0, F.col("names")).otherwise(F.raise_error(message)))
    )
    fields = checked.select("names", F.explode(F.slice("lines", 2, F.size("lines"))).alias("line")).filter(F.trim("line") != "")
    value = lambda c: F.get(F.split("line", ","), (F.array_position("names", c) - 1).cast("int")).alias(c)
    return as_feed_rows(fields.select(*[value(c) for c in LIVE_REQUIRED]))
