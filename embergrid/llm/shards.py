"""Shards of nearly equal bytes: sampled splitters, exact sizes of the ranges between them, one running sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from embergrid.llm.records import arrow_step
from embergrid.session import materialize

Key = tuple[int, int, int]  # text mark, area, row
LEAST = -(1 << 63)
OVERFULL = 4  # a range of so many times its share is cut again
PER_RANGE = 8  # sampled keys for each range wanted


def aligned(cuts: list[Key]) -> list[Key]:
    """Splitters from sampled keys: at the start of a text's copies, unless the copies of one text were cut more than once;
    these get ranges of their own."""
    marks = [c[0] for c in cuts]
    many = {m for m, following in zip(marks, marks[1:]) if m == following}
    out = {(m, LEAST, LEAST) for m in marks} | {c for c in cuts if c[0] in many} | {(m + 1, LEAST, LEAST) for m in many}
    return sorted(out)


def range_of(splitters: list[Key], mark: np.ndarray, area: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of splitters at or below each key."""
    s = np.array(splitters, np.int64).reshape(-1, 3)
    low, high = (np.searchsorted(s[:, 0], mark, side) for side in ("left", "right"))
    for m in np.unique(mark[low < high]):
        rows = np.flatnonzero(mark == m)
        a, b = int(low[rows[0]]), int(high[rows[0]])
        ties = s[a:b, 1:]
        if len(ties) == 1:
            low[rows] = b  # the splitter stands before all copies
            continue
        below, upto = (np.searchsorted(ties[:, 0], area[rows], side) for side in ("left", "right"))
        low[rows] = a + below
        for at in np.flatnonzero(below < upto):  # the area of a splitter: its rows decide
            low[rows[at]] += np.searchsorted(ties[below[at] : upto[at], 1], row[rows[at]], "right")
    return low.astype(np.int64)


def _in_ranges(keyed: DataFrame, splitters: list[Key]) -> DataFrame:
    """``keyed`` with the column range."""
    names = [*keyed.columns, "range"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column(c).to_numpy() for c in ("mark", "place", "row"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range_of(splitters, *key))], names=names)

    return arrow_step(keyed, run, T.StructType([*keyed.schema, T.StructField("range", T.LongType())]))


def _cuts(sample: list, share: float) -> list[Key]:
    """Every key at which the weight summed so far enters another share."""
    cuts, upto, filled = [], 0.0, 0
    for row in sorted(sample):
        upto += row[3]
        if int(upto / share) > filled:
            filled = int(upto / share)
            cuts.append((row[0], row[1], row[2]))
    return cuts


def shard_documents(
    documents: DataFrame, *, shards: int = 16, ranges_per_shard: int = 32, rows_per_range: int = 500_000, whole_share: float = 0.05,
    seed: int = 12, max_rounds: int = 12,
) -> DataFrame:
    """(area, size, text_crc32, law, shard, slot): every analysis document (area, document) in one of ``shards`` shards of nearly
    equal bytes, with its place there (0, 1, 2 ...).

    Documents are ordered by a mark of the text (MD5) and the area, so copies of a text are neighbours. Keys are
    sampled by size (half the weight is the share of bytes, half that of rows, so a range has a bounded number of either),
    quantiles of the sample split the order into ranges, and a range that turns out overfull is sampled and split again. The exact
    sizes of the ranges then place each document: its shard is the one in which the middle of its bytes lies, counted
    over all documents in order. The copies of a text go together, by their common middle, unless they hold more
    than ``whole_share`` of a shard. So a shard departs from its share by at most half of that and half a document at
    either end, and the result depends on neither sample nor partitions.

    Size is the UTF-8 length of the text (null: 0) plus 1. Null and empty texts are copies of each other. Null areas come
    first. Repeated rows are kept apart by their place in the table, so a hot key is split like any other. No group is
    collected; a text is read once. Sample and ranges on the driver: ``PER_RANGE`` keys for each of max(shards x ranges_per_shard,
    rows / rows_per_range) ranges. Areas that aren't whole numbers are ordered by their hash. Empty table: no row. Other
    columns are left out, whatever their names.
    """
    text = F.coalesce(F.col("document"), F.lit(""))
    whole_number = documents.schema["area"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    keyed = materialize(documents.select(
        "area", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").alias("mark"),
        F.coalesce(F.col("area").cast("bigint") if whole_number else F.xxhash64("area"), F.lit(LEAST)).alias("place"),
        F.monotonically_increasing_id().alias("row"),
    ), "keyed")
    rows, size = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return keyed.select("area", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    wanted = min(rows, max(shards * ranges_per_shard, -(-rows // rows_per_range)))
    weight = F.col("size") / size / 2 + F.lit(0.5 / rows)
    lot = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)

    def sampled(df: DataFrame, rate: float) -> list:
        chance = F.least(F.lit(1.0), weight * rate)
        return df.filter(lot < chance).select("mark", "place", "row", (weight / chance).alias("w")).collect()

    rate = float(wanted * PER_RANGE)
    cuts = _cuts(sampled(keyed, rate), 1 / wanted)
    for _ in range(max_rounds):
        splitters = aligned(sorted(set(cuts)))
        ranged = _in_ranges(keyed, splitters)
        filled = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum(weight).alias("w")).collect()
        over = [r["range"] for r in filled if r["w"] > OVERFULL / wanted and r["n"] > 1]
        if not over:
            break
        rate *= PER_RANGE
        more = _cuts(sampled(ranged.join(_listed(keyed, over), "range", "left_semi"), rate), 1 / wanted)
        if not set(more) - set(cuts):
            break
        cuts += more

    placed = _in_ranges(keyed, splitters).join(_offsets(keyed, splitters, filled), "range")
    inside = Window.partitionBy("range").orderBy("mark", "place", "row")
    copies = Window.partitionBy("range", "mark")
    placed = placed.withColumns({
        "upto": F.col("bytes_before") + F.sum("size").over(inside), "rank": F.col("rows_before") + F.row_number().over(inside) - 1,
    }).withColumns({
        "first": F.coalesce("hot_first", F.min(F.col("upto") - F.col("size")).over(copies)),
        "all": F.coalesce("hot_all", F.sum("size").over(copies)),
    })
    together = F.col("all") * shards <= F.lit(whole_share) * size
    twice = F.when(together, 2 * F.col("first") + F.col("all")).otherwise(2 * F.col("upto") - F.col("size"))  # the middle, doubled
    shard = F.expr(f"least({shards - 1}, cast(twice * {shards} div {2 * size} as int))")
    placed = placed.withColumn("twice", twice).select("area", "size", "text_crc32", "rank", shard.alias("shard"))
    placed = materialize(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("start"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "area", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("start")).alias("slot")
    )


def _listed(like: DataFrame, ranges: list[int]) -> DataFrame:
    return like.sparkSession.createDataFrame([(r,) for r in ranges], "range bigint")


def _offsets(like: DataFrame, splitters: list[Key], filled: list) -> DataFrame:
    """(range, rows_before, bytes_before, hot_first, hot_all): where each range begins; of ranges that hold copies of one
    text alone, also where these begin and how many bytes they have."""
    counts = {r["range"]: (r["n"], r["bytes"]) for r in filled}
    owner, rows, size = {}, 0, 0
    for i, (low, high) in enumerate(zip(splitters, splitters[1:]), 1):
        if high <= (low[0] + 1, LEAST, LEAST):
            owner[i] = low[0]
    out, hot = [], {}
    for r in sorted(counts):
        n, b = counts[r]
        out.append([r, rows, size, None, None])
        if r in owner:
            start, held = hot.get(owner[r], (size, 0))
            hot[owner[r]] = (start, held + b)
        rows, size = rows + n, size + b
    for row in out:
        if row[0] in owner:
            row[3:] = hot[owner[row[0]]]
    return like.sparkSession.createDataFrame(out, "range bigint, rows_before bigint, bytes_before bigint, hot_first bigint, hot_all bigint")
