"""Connected components of a link table by alternating star steps, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from embergrid.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node it sees, itself included. Rows come as u > v, so a
    node's smaller neighbours are where it stands as u; one that never does is the smallest itself."""
    low = links.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return links.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the smallest of them. Rows come as u > v."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    return (
        links.join(low, "u").select(F.col("v").alias("a"), "u", "m")
        .select(F.explode(F.array("a", "u")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    )


def components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(u, root): every linked node except the roots, with the smallest node of its component.

    ``links`` (u, v) may hold either direction, repeats and self links; nodes of any ordered type. Each round is
    written to the shared folder, so a lost executor costs a re-read. Rounds needed grow with the logarithm of
    the longest chain. No link at all: no row. A star of a hot node is pre-aggregated before the shuffle
    (min per task) and its rows are spread by their own keys.
    """
    now = materialize(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    state = None
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select("u", F.col("v").alias("root"))
        state = tuple(seen)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
