"""Benchmark leaks by greedy string tiling: how much of a test item reappears in a document, in any order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embergrid.llm.records import arrow_step
from embergrid.session import materialize

#: Bits of the table of item seeds that every task gets: 2^24 bits are 2 MB, however many items there are.
_TABLE_BITS = 24
_BASE = 0x9E3779B97F4A7C15 | 1


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    import re

    return re.findall(r"\w+", text.lower()) if text else []


def seed_hashes(tokens: list[str], size: int, known: dict[str, int]) -> np.ndarray:
    """Rolling polynomial hash (mod 2^64) of every run of ``size`` tokens, as signed 64-bit numbers."""
    from xxhash import xxh64_intdigest

    if len(tokens) < size:
        return np.empty(0, np.int64)
    if len(known) > 150_000:
        known.clear()
    for t in tokens:
        if t not in known:
            known[t] = xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 7)
    ids = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(_BASE) + ids[i : len(ids) - size + 1 + i]
    out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _slots(seeds: np.ndarray) -> np.ndarray:
    return (seeds.view(np.uint64) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def tile(item: list[str], passages: list[list[str]], shortest: int) -> list[tuple[int, int, int, int]]:
    """Greedy string tiling of ``item`` by passages: (item start, passage, start in it, length) of every tile.

    Search lengths fall to ``shortest``. For each, Karp-Rabin hashes of the unmarked item windows are looked up
    with those of the unmarked passage windows; matches are confirmed and extended as far as they go, and marked on
    both sides from the longest on (ties: smaller item start, passage, start). When one meets words marked
    before it, the rest is searched again. A mark is never lifted.
    """
    free_item = [True] * len(item)
    free = [[True] * len(p) for p in passages]
    tiles: list[tuple[int, int, int, int]] = []

    def windows(tokens: list[str], open_: list[bool], size: int) -> Iterator[tuple[int, int]]:
        rolled, run, lead = 0, 0, pow(_BASE, size, 1 << 61)
        codes = [hash(t) & 0xFFFFFFFF for t in tokens]
        for i, code in enumerate(codes):
            if not open_[i]:
                rolled, run = 0, 0
                continue
            rolled = (rolled * _BASE + code - (codes[i - size] * lead if run >= size else 0)) % (1 << 61)
            run += 1
            if run >= size:
                yield i - size + 1, rolled

    size = max(shortest, min(20, len(item)))
    while True:
        table: dict[int, list[int]] = {}
        for at, h in windows(item, free_item, size):
            table.setdefault(h, []).append(at)
        matches = []
        for n, tokens in enumerate(passages) if table else ():
            for at, h in windows(tokens, free[n], size):
                for start in table.get(h, ()):
                    k = 0
                    while (
                        start + k < len(item) and at + k < len(tokens) and free_item[start + k] and free[n][at + k]
                        and item[start + k] == tokens[at + k]
                    ):
                        k += 1
                    if k >= size:
                        matches.append((-k, start, n, at))
        again = False
        for k, start, n, at in sorted(matches):
            if not (all(free_item[start : start - k]) and all(free[n][at : at - k])):
                again = True  # what is left of it may be longer than the next: look anew
                break
            free_item[start : start - k] = [False] * -k
            free[n][at : at - k] = [False] * -k
            tiles.append((start, n, at, -k))
        if not again:
            if size <= shortest:
                return tiles
            size = max(shortest, size // 2)


def _seed_table(items: DataFrame) -> bytes:
    """Bit table of the seeds of all items. Its size is fixed; a full table only lets more windows through to the join."""
    slot = F.shiftrightunsigned("seed", 64 - _TABLE_BITS)
    words = (
        items.select(slot.alias("slot")).distinct()
        .select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    )
    table = np.zeros(1 << (_TABLE_BITS - 6), np.int64)
    for row in words:
        table[row["w"]] = row["b"]
    return table.astype("<i8").tobytes()


def benchmark_leaks(
    documents: DataFrame, benchmark: DataFrame, *, seed_words: int = 5, min_coverage: float = 0.5, keep_all: bool = False,
) -> DataFrame:
    """(area, item_id, coverage, n_tiles, longest): documents (area, document) that hold much of an item (item_id, text).

    ``coverage`` is the share of an item's words inside tiles of at least ``seed_words`` words (of the item's length, if that is
    less) that the document shares with it, wherever they stand; pairs with ``min_coverage`` or more are returned, or all pairs
    that share a seed with ``keep_all``. Every word of every document is read. A null or empty text on either side
    matches nothing. Rows that repeat an area are one document; every row with a null area is a document of its own. All texts of
    an item_id are searched, null ones like any other; the one that a document holds most of counts. Other columns are
    ignored. Empty tables: no row.

    How it runs: windows of the documents are looked up in a bit table of the items' seeds of fixed size, and
    only runs of windows that hit leave the scan, with their words. A tile is a run of shared seeds, so these
    passages hold every tile. Passages meet items by an equi-join of their seeds alone; the words follow once for each item met.
    """
    name = F.concat(F.col("item_id").isNull().cast("string"), F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))
    texts = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).select("item_id", "text", F.md5(name).alias("item")).dropDuplicates(["item"])

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out: list[tuple] = []
            for item_id, text, item in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = words_of(text)
                if tokens:
                    out.append((item_id, item, tokens, seed_hashes(tokens, min(seed_words, len(tokens)), known).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], batch.column(0).type), pa.array([r[1] for r in out], pa.string()),
                 pa.array([r[2] for r in out], pa.list_(pa.string())), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
                names=["item_id", "item", "words", "seeds"],
            )

    item_type = texts.schema["item_id"].dataType.simpleString()
    items = materialize(
        arrow_step(texts, cut_items, f"item_id {item_type}, item string, words array<string>, seeds array<bigint>"), "items"
    )
    seeds = items.select("item", F.explode("seeds").alias("seed")).distinct()
    table = documents.sparkSession.sparkContext.broadcast(_seed_table(seeds))
    short = items.select(F.least(F.size("words"), F.lit(seed_words)).alias("size")).distinct()
    sizes = sorted({r["size"] for r in short.collect()})  # at most seed_words numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(table.value, np.uint8), bitorder="little").view(bool)
        known: dict[str, int] = {}
        for batch in batches:
            source, at, words, hits = [], [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                tokens = words_of(text)
                inside = np.zeros(len(tokens) + 1, np.int32)
                found = []
                for size in sizes:
                    own = seed_hashes(tokens, size, known)
                    hit = np.flatnonzero(bits[_slots(own)])
                    np.add.at(inside, hit, 1)
                    np.add.at(inside, hit + size, -1)
                    found.append((hit, own[hit]))
                edge = np.flatnonzero(np.diff(np.r_[False, np.cumsum(inside) > 0].astype(np.int8)))
                for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    source.append(i)
                    at.append(start)
                    words.append(tokens[start:stop])
                    hits.append(np.unique(np.concatenate([own[(hit >= start) & (hit < stop)] for hit, own in found])).tolist())
            rows = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int64()), pa.array(words, pa.list_(pa.string())),
                 pa.array(hits, pa.list_(pa.int64()))], names=["area", "row", "at", "passage", "hits"],
            )

    area_type = documents.schema["area"].dataType.simpleString()
    own_row = F.when(F.col("area").isNull(), F.monotonically_increasing_id())  # names a document that has no area
    passages = materialize(
        arrow_step(
            documents.select("area", own_row.alias("row"), "document"), scan, f"area {area_type}, row bigint, at bigint, passage array<string>, hits array<bigint>"
        ).withColumn("id", F.monotonically_increasing_id()), "passages",
    )
    met = materialize(passages.select("id", F.explode("hits").alias("seed")).join(seeds, "seed").select("id", "item").distinct(), "met")
    pairs = met.join(passages.select("id", "area", "row", "at", "passage"), "id").groupBy("area", "row", "item").agg(
        F.sort_array(F.collect_list(F.struct("at", "passage"))).alias("found")  # words of one document at most
    ).join(items.select("item", "item_id", "words"), "item")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, count, longest = [], [], []
            for words, found in zip(batch.column("words").to_pylist(), batch.column("found").to_pylist()):
                tiles = tile(words, [f["passage"] for f in found], min(seed_words, len(words)))
                share.append(sum(t[3] for t in tiles) / len(words))
                count.append(len(tiles))
                longest.append(max((t[3] for t in tiles), default=0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("area"), batch.column("row"), batch.column("item_id"), pa.array(share, pa.float64()), pa.array(count, pa.int64()),
                 pa.array(longest, pa.int64())], names=["area", "row", "item_id", "coverage", "n_tiles", "longest"],
            )

    measured = arrow_step(
        pairs.select("area", "row", "item_id", "words", "found"), measure,
        f"area {area_type}, row bigint, item_id {item_type}, coverage double, n_tiles bigint, longest bigint",
    )
    kept = measured.filter("n_tiles > 0") if keep_all else measured.filter(F.col("coverage") >= min_coverage)
    best = kept.groupBy("area", "row", "item_id").agg(F.max(F.struct("coverage", "longest", "n_tiles")).alias("best"))
    return best.select("area", "item_id", "best.coverage", "best.n_tiles", "best.longest")
