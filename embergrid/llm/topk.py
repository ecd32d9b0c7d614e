"""Exact best matches of vectors with a vector-approximation file: one-byte cells are scanned for bounds, then vectors are
read in the order of their bounds until the kth result is certain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from embergrid.llm.records import arrow_step
from embergrid.session import materialize

_LONG = (1 << 63) - 1

#: Cells of a vector: its range is cut into so many equal parts, one byte names a part.
CELLS = 256


def usable_profiles(profiles: DataFrame, scale: int) -> DataFrame:
    """(row, area, profile array<double>): every component times ``scale``, rounded down to a whole number.

    Rows with a null area, a null profile, or a component that is null or not finite (also after scaling) take no part.
    Every other row does, repeated areas and empty profiles included; ``row`` tells them apart.
    """
    scaled = F.transform("profile", lambda x: x.cast("double") * scale)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(F.when(F.abs(x) < float(1 << 53), x)).cast("double")).otherwise(x)
    return (
        profiles.filter(F.col("area").isNotNull() & F.col("profile").isNotNull()).filter(F.coalesce(finite, F.lit(False)))
        .select(F.monotonically_increasing_id().alias("row"), "area", F.transform(scaled, whole).alias("profile"))
    )


def cells_of(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Approximation of vectors that lie one after the other: cell of every component (one byte), and lowest value and cell
    width of every vector. A component lies in [low + cell * step, low + (cell + 1) * step], but for rounding."""
    low, high = np.zeros(len(lengths)), np.zeros(len(lengths))
    filled = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[filled]
    if len(starts):
        low[filled], high[filled] = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(all="ignore"):  # a range beyond a double has no cells; its bounds are infinite
        step = (high - low) / CELLS
        cells = np.floor(np.nan_to_num((values - low[owner]) / step[owner], nan=0.0))
    return np.clip(cells, 0, CELLS - 1).astype(np.uint8), low, step


def bounds_of(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the inner product of every query with every vector, from the vectors' cells."""
    plus, minus = np.maximum(queries, 0.0).sum(axis=1)[:, None], np.minimum(queries, 0.0).sum(axis=1)[:, None]
    with np.errstate(all="ignore"):
        middle = low * (plus + minus) + step * (queries @ cells.astype(np.float64).T)
        # far above what the sums above can lose by rounding
        slack = 1e-12 * (plus - minus) * (np.abs(low) + CELLS * step)
        under, over = middle + step * minus - slack, middle + step * plus + slack
        lost = ~(np.isfinite(under) & np.isfinite(over))
    under[lost], over[lost] = -np.inf, np.inf
    return np.clip(under, -float(1 << 63), float(1 << 63)), np.clip(over, -float(1 << 63), float(1 << 63))


def possible(lower: np.ndarray, upper: np.ndarray, areas: np.ndarray, k: int) -> np.ndarray:
    """Positions that may be among the ``k`` best: fewer than ``k`` others are surely better, ties to the smaller area."""
    if len(lower) <= k:
        return np.arange(len(lower))
    kth = np.partition(lower, len(lower) - k)[len(lower) - k]
    sure = np.flatnonzero(lower >= kth)
    last = areas[sure[np.lexsort((areas[sure], -lower[sure]))[k - 1]]]
    return np.flatnonzero((upper > kth) | ((upper == kth) & (areas <= last)))


def exact_scores(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Inner products, row by row, of whole numbers without rounding; one beyond 64 bits counts as the nearest 64-bit number."""
    largest = left.shape[1] * np.abs(left).max(initial=0.0) * np.abs(right).max(initial=0.0)
    if largest < float(1 << 62):
        return (left.astype(np.int64) * right.astype(np.int64)).sum(axis=1).tolist()
    return [max(-_LONG, min(_LONG, sum(int(a) * int(b) for a, b in zip(x, y)))) for x, y in zip(left, right)]


def _approximation(rows: DataFrame, k: int) -> DataFrame:
    """(row, area, dims, cells, low, step): the approximation file. Of equal vectors only those stay that can be among the
    ``k`` best of any query: the smallest k + 1 areas (one may be the query's own), each with at most ``k`` rows."""

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cells, low, step = cells_of(lists.flatten().to_numpy(), lengths)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(cells.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lengths.astype(np.int32)), packed, pa.array(low), pa.array(step)],
                names=["row", "area", "h0", "h1", "dims", "cells", "low", "step"],
            )

    marked = rows.select("row", "area", F.xxhash64("profile").alias("h0"), F.xxhash64(F.lit(1), "profile").alias("h1"), "profile")
    made = arrow_step(marked, approximate, "row bigint, area bigint, h0 bigint, h1 bigint, dims int, cells binary, low double, step double")
    same, equal = Window.partitionBy("h0", "h1", "area").orderBy("row"), Window.partitionBy("h0", "h1").orderBy("area")
    few = made.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k)
    return few.withColumn("nth", F.dense_rank().over(equal)).filter(F.col("nth") <= k + 1).drop("h0", "h1", "nth")


def _scan(cells: DataFrame, asking: DataFrame, k: int, block_rows: int, query_rows: int) -> DataFrame:
    """(asks, row, area, lower, upper): what may be among a query's ``k`` best of its block of the approximation file."""
    blocks, parts = max(1, -(-cells.count() // block_rows)), max(1, -(-asking.count() // query_rows))
    dealt = lambda of: F.pmod(F.xxhash64("row", F.lit(5)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    none = F.lit(None)
    left = cells.select(
        dealt(blocks).alias("block"), every(parts).alias("part"), "dims", F.lit(1).alias("held"), "row", "area", "cells", "low", "step",
        none.cast("array<double>").alias("profile"),
    )
    right = asking.select(
        every(blocks).alias("block"), dealt(parts).alias("part"), F.size("profile").alias("dims"), F.lit(0).alias("held"), "row", "area",
        none.cast("binary").alias("cells"), F.lit(0.0).alias("low"), F.lit(0.0).alias("step"), "profile",
    )
    grouped = left.union(right).repartition(max(1, min(blocks * parts, 4096)), "block", "part").sortWithinPartitions("block", "part", "dims", "held")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of one (block, part, dims) together; they come sorted."""
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and tuple(keys[a]) != key:
                    yield pa.Table.from_batches(held)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            asks = table.column("held").to_numpy() == 0
            if asks.all() or not asks.any():
                continue
            dims, split = table.column("dims")[0].as_py(), int(asks.sum())  # queries come first
            head, tail = table.slice(0, split), table.slice(split)
            queries = np.concatenate([c.flatten().to_numpy() for c in head.column("profile").chunks]).reshape(split, dims)
            cells = np.frombuffer(b"".join(tail.column("cells").to_pylist()), np.uint8).reshape(tail.num_rows, dims)
            rows, areas = tail.column("row").to_numpy(), tail.column("area").to_numpy()
            lower, upper = bounds_of(queries, cells, tail.column("low").to_numpy(), tail.column("step").to_numpy())
            for row, area, under, over in zip(head.column("row").to_pylist(), head.column("area").to_pylist(), lower, upper):
                other = np.flatnonzero(areas != area)
                took = other[possible(under[other], over[other], areas[other], k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(took), row)), pa.array(rows[took]), pa.array(areas[took]), pa.array(under[took]), pa.array(over[took])],
                    names=["asks", "row", "area", "lower", "upper"],
                )

    return arrow_step(grouped, scan, "asks bigint, row bigint, area bigint, lower double, upper double")


def _still_possible(found: DataFrame, sure: DataFrame, k: int) -> DataFrame:
    """Rows of ``found`` (asks, area, upper) that may still be among the ``k`` best of their query, given what is sure of some of
    its rows: (asks, area, least), where the score is ``least`` or more."""
    best = sure.withColumn("nth", F.row_number().over(Window.partitionBy("asks").orderBy(F.desc("least"), "area"))).filter(F.col("nth") <= k)
    kth = best.groupBy("asks").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct((-F.col("least")).alias("less"), "area")).alias("last"))
    kth = kth.filter(F.col("n") == k).select("asks", (-F.col("last.less")).alias("least"), F.col("last.area").alias("last"))
    open_ = (F.col("upper") > F.col("least")) | ((F.col("upper") == F.col("least")) & (F.col("area") <= F.col("last")))
    return found.join(kth, "asks", "left").filter(F.col("least").isNull() | open_).drop("least", "last")


def _read(found: DataFrame, rows: DataFrame, asking: DataFrame) -> DataFrame:
    """``found`` (asks, row, area) with the exact score; a vector that many queries want is fetched once."""
    wanted = materialize(rows.join(found.select("row").distinct(), "row", "left_semi").select("row", "profile"), "vectors_read")
    pairs = found.join(wanted, "row").join(asking.select(F.col("row").alias("asks"), F.col("profile").alias("query")), "asks")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, queries = batch.column(3), batch.column(4)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            values, asked, ends = lists.flatten().to_numpy(), queries.flatten().to_numpy(), np.cumsum(dims)
            scores = np.zeros(len(dims), np.int64)
            for d in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == d)
                place = (ends[at] - d)[:, None] + np.arange(d)
                scores[at] = exact_scores(values[place], asked[place])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores)], names=["asks", "row", "area", "score"])

    return arrow_step(pairs.select("asks", "row", "area", "profile", "query"), score, "asks bigint, row bigint, area bigint, score bigint")


def nearest_profiles(
    profiles: DataFrame, queries: DataFrame | None = None, *, k: int = 10, scale: int = 1024, block_rows: int = 8192, query_rows: int = 512,
) -> DataFrame:
    """(area, rank, other, score): the ``k`` areas whose profile (area, profile) has the largest inner product with that
    of each query area, in whole numbers of 1/``scale``; ties go to the smaller area.

    ``queries`` (area) names the areas that ask; None: all. An area is no candidate of its own; with fewer than ``k``
    others all are returned. Profiles of different length don't meet. See :func:`usable_profiles` for rows that
    take no part. Rows that repeat an area are candidates each, and each asks for itself. Products are exact; a score beyond
    64 bits counts as the nearest 64-bit number. Empty tables: no row. Areas are whole numbers.

    How it runs: every vector gets one byte a component, its cells. Blocks of about ``block_rows`` cells meet blocks of about
    ``query_rows`` queries, and a group, whose size is fixed, returns what its bounds can't rule out. The kth lower bound over
    all blocks rules out most of that. Of the rest the 2 ``k`` with the highest bounds are read, by key; then those whose
    bound still reaches the kth score read. No other exact vector leaves the table.
    """
    rows = materialize(usable_profiles(profiles, scale), "profiles")
    asking = rows if queries is None else rows.join(queries.select("area").distinct(), "area", "left_semi").select("row", "area", "profile")
    asking = materialize(asking, "profile_queries")
    cells = materialize(_approximation(rows, k), "profile_cells")
    found = materialize(_scan(cells, asking, k, block_rows, query_rows), "block_bounds")
    ordered = Window.partitionBy("asks").orderBy(F.desc("upper"), "area", "row")
    left = _still_possible(found, found.select("asks", "area", F.col("lower").alias("least")), k)
    left = materialize(left.withColumn("turn", F.row_number().over(ordered)), "open_bounds")
    first = materialize(_read(left.filter(F.col("turn") <= 2 * k), rows, asking), "first_scores")
    reached = first.select("asks", "area", F.col("score").cast("double").alias("least"))
    rest = materialize(_still_possible(left.filter(F.col("turn") > 2 * k), reached, k), "second_bounds")
    scores = first.union(_read(rest, rows, asking))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("asks").orderBy(F.desc("score"), "area"))).filter(F.col("rank") <= k)
    return ranked.select("asks", "rank", F.col("area").alias("other"), "score").join(
        asking.select(F.col("row").alias("asks"), "area"), "asks"
    ).select("area", "rank", "other", "score")
