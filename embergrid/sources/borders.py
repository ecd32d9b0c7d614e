"""Area borders from GeoJSON (features one per line, or a FeatureCollection)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embergrid.operators.geo import UNITS

_POLYGON = "array<array<array<double>>>"
_FEATURE = "type string, properties struct<id: string>, geometry struct<type: string, coordinates: string>"


def read_borders(spark: SparkSession, path: str, collection: bool = False) -> DataFrame:
    """Edges (area, poly, ring, x1, y1, x2, y2) in whole units of 1e-4 degrees.

    Polygon and MultiPolygon coordinates nest differently, so they are read as text and parsed by type.
    """
    if collection:
        raw = spark.read.option("multiLine", True).schema(f"features array<struct<{_struct(_FEATURE)}>>").json(path)
        features = raw.select(F.inline("features"))
    else:
        features = spark.read.schema(_FEATURE).json(path)
    text = F.col("geometry.coordinates")
    many = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json(text, _POLYGON))).otherwise(
        F.from_json(text, f"array<{_POLYGON}>")
    )
    return edges(features.select(F.col("properties.id").alias("area"), many.alias("polys")))


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().split(" ", 1) for part in _split(ddl)))


def _split(ddl: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return [*parts, cur]


def edges(shapes: DataFrame) -> DataFrame:
    """(area, polys) with nested coordinates -> one row per border edge."""
    q = lambda v: F.floor(v * UNITS + 0.5).cast("bigint")
    rings = shapes.select("area", F.posexplode("polys").alias("poly", "rings")).select(
        "area", "poly", F.posexplode("rings").alias("ring", "points")
    )

    def edge(i: Column) -> Column:
        a, b = F.get("points", i), F.get("points", i + 1)
        return F.struct(
            q(a[0]).alias("x1"), q(a[1]).alias("y1"), q(b[0]).alias("x2"), q(b[1]).alias("y2")
        )

    steps = F.when(F.size("points") > 1, F.sequence(F.lit(0), F.size("points") - 2)).otherwise(F.array().cast("array<int>"))
    return rings.select("area", "poly", "ring", F.inline(F.transform(steps, edge)))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(area, name, bbox, view) from a JSON array of areas."""
    schema = "id string, name string, bbox array<double>, view array<double>"
    return spark.read.option("multiLine", True).schema(schema).json(path).withColumnRenamed("id", "area")
