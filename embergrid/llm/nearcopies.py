"""Near copies by SimHash fingerprints and an inverted index on the positions of their bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embergrid.llm.components import components
from embergrid.llm.records import arrow_step, ascii_lower, by_row
from embergrid.session import materialize

#: Step between lanes and multipliers of the mixing (SplitMix64); lane 0 keeps the shingle hash itself.
_LANE_STEP, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; a shorter text is one shingle, no word gives none."""
    from xxhash import xxh64_intdigest

    tokens = ascii_lower(text).split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    return np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64)


def fingerprint(hashes: np.ndarray, lane: int = 0) -> int:
    """Signed 64-bit number whose bits are those set in over half the hashes."""
    if not len(hashes):
        return 0
    if lane:
        hashes = hashes + np.uint64(lane * _LANE_STEP % 2**64)
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(_MIX[0])
        hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(_MIX[1])
        hashes = hashes ^ (hashes >> np.uint64(31))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(
    documents: DataFrame, *, words: int = 3, seed: int = 42, lanes: int = 1, keep: list[str] | None = None
) -> DataFrame:
    """(area, f0, f1, ...): fingerprint of each document (area, document), one 64-bit column per lane.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null, empty and blank texts get zero.
    """
    names = [f"f{k}" for k in range(lanes)]

    def run(texts: list) -> list[list]:
        out: list[list] = [[] for _ in names]
        for text in texts:
            hashes = shingle_hashes(text, words, seed)
            for k in range(lanes):
                out[k].append(fingerprint(hashes, k))
        return out

    return by_row(documents, "document", ", ".join(f"{n} bigint" for n in names), run, keep or ["area"])


def posting_sets(lanes: int, shared: int, postings: int | None) -> list[tuple[int, ...]]:
    """Sets of ``shared`` byte positions. None: all sets, which makes the search exact; else so many drawn with a fixed seed."""
    every = list(combinations(range(8 * lanes), shared))
    return every if postings is None or postings >= len(every) else sorted(Random(1).sample(every, postings))


def _mask(positions: tuple[int, ...], lane: int) -> int:
    """Signed 64-bit number with the bits of those byte positions that lie in the lane."""
    bits = sum(255 << 8 * (p % 8) for p in positions if p // 8 == lane)
    return bits - 2**64 if bits >> 63 else bits


def _near(a: np.ndarray, b: np.ndarray, shared: int, max_bits: int) -> np.ndarray:
    """Which rows of fingerprints (n, lanes) pass the count filter and the check of differing bits."""
    x = np.ascontiguousarray(a ^ b).view(np.uint64)
    alike = (x.view(np.uint8).reshape(len(x), -1) == 0).sum(axis=1)  # positional bytes that a pair shares
    return (alike >= shared) & (np.bitwise_count(x).sum(axis=1) <= max_bits)


def _links_in(key: np.ndarray, prints: np.ndarray, near: Callable) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is ``near`` inside each run of equal keys.

    Small runs compare all their members, run beside run. In a long run a linked member is set aside once it
    has been compared with all that is not linked yet, so a group of near copies costs few passes, not all pairs.
    """
    n, found = len(key), []
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= 24, sizes)
    for gap in range(1, min(24, int(sizes.max(initial=0)))):
        i = np.flatnonzero((key[gap:] == key[:-gap]) & small[gap:])
        if not len(i):
            continue
        ok = near(prints[i], prints[i + gap])
        found.append((prints[i[ok]], prints[i[ok] + gap]))
    for start, size in zip(starts[sizes > 24].tolist(), sizes[sizes > 24].tolist()):
        rest = prints[start : start + size]
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                one = front.pop()
                ok = near(one, rest)
                if ok.any():
                    hits = rest[ok]
                    found.append((np.broadcast_to(one, hits.shape), hits))
                    front.extend(hits)
                    rest = rest[~ok]
    return found


def near_links(
    prints: DataFrame, *, lanes: int = 1, max_bits: int = 3, shared: int = 5, postings: int | None = None,
    block_rows: int = 50_000,
) -> DataFrame:
    """(u, v): links between distinct fingerprints, enough of them to connect all that are within ``max_bits``.

    Inverted index: a fingerprint is listed under every set of ``shared`` byte positions with the bytes found
    there, by a hash of both: lists that share a hash by chance cost some checks and no link. Two fingerprints that differ in at most ``max_bits`` bits keep at least 8 x lanes - max_bits
    bytes, so with ``shared`` at most that number and all sets listed (``postings`` None) every such pair
    meets under some key and none is lost. Pairs under a key are filtered by the count of shared bytes, then by their
    differing bits. With a drawn part of the sets the search for wider radii is approximate.

    A list longer than ``block_rows`` is cut into blocks, and each pair of blocks is a group of its own, so no task
    holds an unbounded list. With 5 of 8 bytes as the key a list has at most 2^24 members in any case.
    """
    names = [f"f{k}" for k in range(lanes)]
    # One constant row of byte masks for each set. Written out as a key each, all 56 sets are 56 expressions, and the driver
    # takes some 290 MB to compile them, twice.
    masks = F.array(*[F.struct(*[F.lit(_mask(s, k)).cast("bigint").alias(n) for k, n in enumerate(names)]) for s in posting_sets(lanes, shared, postings)])
    listed = prints.select(*names, F.posexplode(masks).alias("nth", "mask"))
    key = F.xxhash64("nth", *[F.col(n).bitwiseAND(F.col(f"mask.{n}")) for n in names])
    listed = listed.select(*names, key.alias("key"))
    return links_by_key(listed, names, lambda a, b: _near(a, b, shared, max_bits), node=lanes, block_rows=block_rows)


def links_by_key(listed: DataFrame, names: list[str], near: Callable, *, node: int, block_rows: int = 50_000) -> DataFrame:
    """(u, v): links that connect what is near under each key of ``listed`` (key, names...), all of them long.

    ``near`` gets rows of ``names`` as two arrays and tells which pairs are near. The first ``node`` names make a row's node.
    """
    long = (
        listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows)
        .select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    )
    # a block pair a <= b is the group a * blocks + b; a row goes to the pairs that its own block is part of
    own = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own)
    )
    grouped = listed.join(materialize(long, "long_lists"), "key", "left").select(
        *names, "key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows (key, part, prints) of the run that the next batch may go on with
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            if held and (rows[0, :2] == rows[-1, :2]).all() and (held[-1][-1, :2] == rows[0, :2]).all():
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            cut = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            held = [rows[cut:]]
            yield from emit(rows[:cut])
        if held:
            yield from emit(np.concatenate(held))

    def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        run = np.cumsum(np.r_[False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        found = _links_in(run, np.ascontiguousarray(rows[:, 2:]), near)
        if found:
            pairs = np.unique(np.concatenate([np.concatenate([side[:, :node] for side in f], axis=1) for f in found]), axis=0)
            left, right = pairs[:, :node], pairs[:, node:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(side), pa.list_(pa.int64())) for side in (left, right)], names=["u", "v"]
            )

    dealt = grouped.select("key", F.col("part").cast("bigint").alias("part"), *names).repartition("key", "part")
    return arrow_step(dealt.sortWithinPartitions("key", "part"), link, "u array<bigint>, v array<bigint>").distinct()


def near_copies(
    documents: DataFrame, *, words: int = 3, seed: int = 42, lanes: int = 1, max_bits: int = 3, shared: int = 5,
    postings: int | None = None,
) -> DataFrame:
    """(area, f0, ..., component): every document (area, document) with the smallest area it is linked to.

    Documents with equal fingerprints are linked, as are those whose fingerprints differ in at most ``max_bits``
    bits, directly or through others. Fingerprints are made distinct before the search, so copies of a text cost one
    entry; a hot group is a count per fingerprint. Null, empty and blank texts share fingerprint zero and are
    linked like any other. Rows with a null area take part and get a component, but never name it; a component with no
    area at all gets null. Repeated rows repeat. Empty table: no row. Other columns are left out.
    """
    names = [f"f{k}" for k in range(lanes)]
    rows = materialize(fingerprints(documents, words=words, seed=seed, lanes=lanes), "fingerprints")
    least = materialize(rows.groupBy(*names).agg(F.min("area").alias("least")), "distinct_fingerprints")
    links = materialize(
        near_links(least, lanes=lanes, max_bits=max_bits, shared=shared, postings=postings), "near_links"
    )
    node = F.array(*names)
    roots = components(links)
    named = least.select(*names, "least", node.alias("u")).join(roots, "u", "left").select(
        *names, "least", F.coalesce("root", "u").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("prints"))
    merged = materialize(
        named.join(smallest.filter("prints > 1"), "root").filter(~F.col("least").eqNullSafe(F.col("component")))
        .select(*names, "component"), "merged_fingerprints"
    )
    # whole groups of one fingerprint need no second look: their smallest area is at hand
    own = least.join(merged.withColumnRenamed("component", "other"), names, "left").select(
        *names, F.coalesce("other", "least").alias("component")
    )
    return rows.select("area", *names).join(own, names, "left").select("area", *names, "component")
