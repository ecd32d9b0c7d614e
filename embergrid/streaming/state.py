"""A sliding window of days as one compacted table that every batch replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embergrid.session import child_names, remove


def _versions(spark: SparkSession, home: str) -> list[int]:
    return sorted(int(n) for n in child_names(spark, home) if n.isdigit())


def advance(home: str, rows: DataFrame, number: int, days: int, keys: tuple[str, ...] = ("d", "yi", "xi")) -> DataFrame | None:
    """Table of the last ``days`` days and the newest one after batch ``number``; None as long as there is no row.

    ``rows`` are the batch's new versions of cell-days (update mode): they take the place of older ones. The table before
    the batch is read, the one after it is written beside it, and what is older than both is removed. So a batch opens the
    window's files and no others, however many batches came before, and a repeated batch starts from the same table again.
    """
    spark = rows.sparkSession
    older = [v for v in _versions(spark, home) if v < number]
    now = rows
    if older:
        before = spark.read.schema(rows.schema).parquet(f"{home}/{older[-1]}")
        now = before.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)
    newest = now.agg(F.max("d")).first()[0]
    if newest is None:
        return None
    now.filter(F.col("d") >= F.date_sub(F.lit(newest), days)).write.mode("overwrite").parquet(f"{home}/{number}")
    for v in older[:-1]:
        remove(spark, f"{home}/{v}")
    return spark.read.schema(rows.schema).parquet(f"{home}/{number}")
