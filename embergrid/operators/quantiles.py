"""Exact quantiles of large groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from embergrid.session import materialize

BUCKETS = 1024
MOST_RANKED = 100_000


def grouped_quantile(
    df: DataFrame, keys: list[str], value: str, q: float, nearest: bool = False, most_ranked: int = MOST_RANKED, max_rounds: int = 12
) -> DataFrame:
    """(keys, n, quantile): linear interpolation, or the nearest-rank value at index min(n-1, floor(q*n)).

    Equal values collapse to counts first. A histogram of at most ``BUCKETS`` buckets per group tells where the wanted
    ranks lie, and the range is narrowed to there, again and again, until no group has more than ``most_ranked``
    different values left in it; only these are ranked. A heavy tail takes a few more rounds, never a larger sort. The answer is exact.
    """
    v = F.col(value)
    counts = materialize(df.filter(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")), "value_counts")
    span = counts.groupBy(*keys).agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("values")
    )
    if nearest:
        first = F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))
        second, part = first, F.lit(0.0)
    else:
        at = (F.col("n") - 1) * F.lit(q)
        first, part = F.floor(at), at - F.floor(at)
        second = F.least(F.col("n") - 1, first + 1)
    span = span.withColumns({"r1": first.cast("bigint"), "r2": second.cast("bigint"), "part": part, "below": F.lit(0).cast("bigint")})
    fixed = [*keys, "n", "r1", "r2", "part"]
    span = materialize(span.select(*fixed, "lo", "hi", "below", "values"), "value_range")
    for _ in range(max_rounds):
        largest = span.agg(F.max("values")).first()[0]
        if largest is None or largest <= most_ranked:
            break
        span = materialize(_narrowed(counts, span, keys, fixed, value), "value_range")
    inside = counts.join(span, keys).filter((v >= F.col("lo")) & (v <= F.col("hi")))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("cum", F.col("below") + F.sum("c").over(upto))
    value_at = lambda r: F.min(F.when(F.col("cum") > F.col(r), v))
    return (
        ranked.groupBy(*keys)
        .agg(F.max("n").alias("n"), value_at("r1").alias("v1"), value_at("r2").alias("v2"), F.max("part").alias("part"))
        .select(*keys, "n", (F.col("v1") + (F.col("v2") - F.col("v1")) * F.col("part")).alias("quantile"))
    )


def _narrowed(counts: DataFrame, span: DataFrame, keys: list[str], fixed: list[str], value: str) -> DataFrame:
    """The range cut to the buckets that hold the wanted ranks."""
    v, width = F.col(value), F.col("hi") - F.col("lo")
    bucket = F.when(width > 0, F.floor((v - F.col("lo")) / width * BUCKETS)).otherwise(F.lit(0)).cast("int")
    placed = counts.join(span, keys).filter((v >= F.col("lo")) & (v <= F.col("hi"))).withColumn("b", bucket)
    upto = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # one row per bucket
    histogram = (
        placed.groupBy(*fixed, "below", "b")
        .agg(F.sum("c").alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("values"))
        .withColumn("after", F.col("below") + F.sum("c").over(upto))
        .withColumn("before", F.col("after") - F.col("c"))
    )
    holds = lambda r: (F.col("before") <= F.col(r)) & (F.col(r) < F.col("after"))
    return histogram.filter(holds("r1") | holds("r2")).groupBy(*fixed).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("before").alias("below"), F.sum("values").alias("values")
    )
