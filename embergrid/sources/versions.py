"""The cell-day table at rest, kept up to date: a new build rewrites only the areas' years that changed.

Layout: ``data/version=V/area=A/y=Y`` and ``manifest/V``, a table (area, y, version, rows, digest) of what belongs to
version V. A version exists once its manifest is complete, so a reader sees all of an update or nothing of it, and an update
that failed is written anew under the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from embergrid.session import child_names, materialize, remove
from embergrid.sources.grids import TYPES

MANIFEST = "area int, y int, version int, rows bigint, digest decimal(38,0)"


def grid_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    return sorted(int(n) for n in child_names(spark, f"{path}/manifest") if n.isdigit() and "_SUCCESS" in child_names(spark, f"{path}/manifest/{n}"))


def grid_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(area, y, version, rows, digest) of a version, the newest by default."""
    known = grid_versions(spark, path)
    if version is None and not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{known[-1] if version is None else version}")


def update_grid(grid: DataFrame, path: str) -> int:
    """Make the table at ``path`` hold ``grid`` (area a whole number), and give the version's number.

    A year of an area is left alone if its rows are the same as before, told by their number and the sum of their
    hashes; it is written if it is new or differs, and leaves the manifest if it is gone. If nothing changed there is no
    new version. Repeated rows count each.
    """
    spark = grid.sparkSession
    typed = grid.select(F.col("area").cast("int").alias("area"), *[F.col(c).cast(t).alias(c) for c, t in TYPES.items()], F.year("d").alias("y"))
    digests = typed.groupBy("area", "y").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*TYPES).cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest")
    )
    before = grid_manifest(spark, path)
    number = (grid_versions(spark, path) or [0])[-1] + 1
    same = before.select("area", "y", "rows", "digest", "version")
    judged = materialize(digests.join(same, ["area", "y", "rows", "digest"], "left"), "digests")
    changed = judged.filter("version is null").select("area", "y")
    if number > 1 and changed.isEmpty() and judged.count() == before.count():
        return number - 1
    (
        typed.join(changed, ["area", "y"], "left_semi")
        .repartitionByRange("area", "d").sortWithinPartitions("area", "d", "yi", "xi")
        .select(*TYPES, "area", "y")
        .write.mode("overwrite").option("compression", "zstd").partitionBy("area", "y").parquet(f"{path}/data/version={number}")
    )
    judged.select("area", "y", F.coalesce("version", F.lit(number)).alias("version"), "rows", "digest").write.mode("overwrite").parquet(
        f"{path}/manifest/{number}"
    )
    return number


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of a version, the newest by default: area, d, yi, xi, s, n, frp. Folders of other versions are not opened."""
    schema = ", ".join(f"{c} {t}" for c, t in TYPES.items())
    rows = spark.read.schema(f"{schema}, version int, area int, y int").option("basePath", f"{path}/data").parquet(f"{path}/data")
    # one manifest row per area and year of the record; the join prunes the folders
    live = grid_manifest(spark, path, version).filter(F.col("rows") > 0).select("version", "area", "y")
    return rows.join(F.broadcast(live), ["version", "area", "y"], "left_semi").select("area", *TYPES)


def forget_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest ``keep`` versions, and the data that no kept one refers to."""
    known = grid_versions(spark, path)
    used = {r["version"] for v in known[-keep:] for r in grid_manifest(spark, path, v).select("version").distinct().collect()}
    for v in known[:-keep]:
        remove(spark, f"{path}/manifest/{v}")
    for name in child_names(spark, f"{path}/data"):
        v = int(name.removeprefix("version="))
        if v not in used and v <= known[-1]:  # a later one is being written
            remove(spark, f"{path}/data/{name}")
