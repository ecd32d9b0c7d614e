"""Near copies by the exact similarity of shingle sets: SimHash links by the inverted index of byte positions, prefix lists for what
lies beyond their radius, families of both, comparison of sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from embergrid.llm.components import components
from embergrid.llm.nearcopies import fingerprint, links_by_key, near_links, shingle_hashes
from embergrid.llm.records import arrow_step, by_row
from embergrid.session import materialize

#: Words of 64 bits in the parity print of a set.
PRINT_WORDS = 3

#: Two sets of up to so many shingles together are ruled out by bounds alone, so no similar pair of them is lost. The parity
#: prints of larger sets hold too few bits; they must also differ in at most FAMILY_BITS of 128 SimHash bits, an estimate:
#: at a similarity of 0.8 they differ in 19.4 with a deviation of 4.1, so about one in a million such pairs is further apart.
EXACT_SHINGLES = 700
FAMILY_BITS = 40


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words, seed))


def prefix(shingles: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the set's first shingles, common ones last, that two sets at least so similar share one of theirs."""
    size = len(shingles)
    if not size:
        return shingles
    if len(common):
        late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.concatenate([shingles[~late], shingles[late]])
    return shingles[: size - ceil(similarity * size - 1e-9) + 1]


def parity_print(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 x PRINT_WORDS buckets whether an odd number of the set's shingles falls into it.

    A shingle that only one of two sets holds changes one bit, so the prints of two sets never differ in more bits than the
    sets do in shingles: a bound, not an estimate.
    """
    bits = np.bincount(((shingles >> np.uint64(24)) % np.uint64(64 * PRINT_WORDS)).astype(np.int64), minlength=64 * PRINT_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def may_be_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of listed sets (id, size, place, parity print, SimHash print) can reach the similarity.

    Sets that similar share at least ``need`` shingles. They differ in no more than the rest, which bounds the bits their
    parity prints may differ in; and what can be shared before and after the shingle they are listed under is bounded by
    its places. Only pairs of more than EXACT_SHINGLES are judged by their SimHash prints as well.
    """
    size_a, size_b, at_a, at_b = a[..., 1], b[..., 1], a[..., 2], b[..., 2]
    both = size_a + size_b
    need = np.ceil(similarity / (1 + similarity) * both - 1e-6).astype(np.int64)
    most = np.minimum(at_a, at_b) + 1 + np.minimum(size_a - at_a, size_b - at_b) - 1
    x = np.bitwise_count(np.ascontiguousarray(a[..., 3:] ^ b[..., 3:]).view(np.uint64))
    apart, far = x[..., :PRINT_WORDS].sum(axis=-1, dtype=np.int64), x[..., PRINT_WORDS:].sum(axis=-1, dtype=np.int64)
    bounded = (np.minimum(size_a, size_b) >= need) & (most >= need) & (apart <= both - 2 * need)
    return bounded & ((both <= EXACT_SHINGLES) | (far <= FAMILY_BITS))


def common_shingles(documents: DataFrame, *, words: int, seed: int, sample_documents: int = 20_000, least: int = 20) -> np.ndarray:
    """Sorted hashes of the shingles that ``least`` texts of a sample hold. They set the order of shingles only: any
    order finds the same pairs, this one keeps lists short."""
    draw = F.pmod(F.xxhash64("document"), F.lit(1_000_003)) / 1_000_003.0
    drawn = documents.filter(draw < sample_documents / max(1, documents.count())).select("document").distinct()
    sets = by_row(drawn, "document", "s array<bigint>", lambda texts: [[shingle_set(t, words, seed).view(np.int64) for t in texts]], [])
    rows = sets.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("s").collect()
    return np.sort(np.array([r["s"] for r in rows], np.int64).view(np.uint64))


def near_sets(documents: DataFrame, *, words: int, seed: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (area, row, id) of the documents (area, document), and the distinct sets (id, least, row, size, print, prefix).

    ``id`` is a digest of the set of shingles (0: no word), ``row`` a hash of area and text, ``print`` the set's parity
    print and 128 SimHash bits, ``prefix`` the shingles it is listed under.
    """
    common = common_shingles(documents, words=words, seed=seed)

    def run(texts: list) -> list[list]:
        from xxhash import xxh64_intdigest

        out: list[list] = [[], [], [], []]
        for text in texts:
            s = shingle_set(text, words, seed)
            digest = np.array([xxh64_intdigest(s.tobytes(), seed)], np.uint64).view(np.int64)[0] if len(s) else 0
            for column, value in zip(out, (int(digest), len(s), [*parity_print(s).tolist(), fingerprint(s), fingerprint(s, 1)], prefix(s, common, similarity).view(np.int64))):
                column.append(value)
        return out

    source = documents.select("area", "document", F.xxhash64("area", "document").alias("row"))
    made = by_row(source, "document", "id bigint, size bigint, print array<bigint>, prefix array<bigint>", run, ["area", "row"])
    rows = materialize(made, "set_prefixes")
    sets = rows.groupBy("id").agg(
        F.min("area").alias("least"), F.min("row").alias("row"), F.any_value(F.struct("size", "print", "prefix")).alias("x")
    ).select("id", "least", "row", "x.*")
    return rows.select("area", "row", "id"), materialize(sets, "distinct_sets")


def fingerprint_links(sets: DataFrame, *, max_bits: int = 3) -> DataFrame:
    """(u, v): links between sets, enough to connect all whose fingerprints differ in at most ``max_bits`` bits.

    The links of ``nearcopies``: all postings of five byte positions, the count filter and the check of differing bits, over
    distinct fingerprints. Sets without a shingle take no part.
    """
    prints = sets.filter("id <> 0").select("id", F.col("print")[PRINT_WORDS].alias("f0"))
    first = materialize(prints.groupBy("f0").agg(F.min("id").alias("first")), "distinct_prints")
    alike = prints.join(first, "f0").filter("id <> first").select(F.array("id").alias("u"), F.array("first").alias("v"))
    near = materialize(near_links(first.select("f0"), max_bits=max_bits), "print_links")
    end = lambda side: first.select(F.col("f0").alias(f"f{side}"), F.array("first").alias(side))
    ends = near.select(F.col("u")[0].alias("fu"), F.col("v")[0].alias("fv")).join(end("u"), "fu").join(end("v"), "fv")
    return alike.union(ends.select("u", "v"))


def families(sets: DataFrame, *, similarity: float) -> DataFrame:
    """(id, row, family, size): the sets of every family of two or more. Any two sets whose fingerprints are near, or that
    share a shingle of their prefixes and pass :func:`may_be_similar`, are of one family, so a family holds whole groups of near
    copies. Sets at the similarity wanted can differ in more bits than the fingerprints' radius; the prefixes find those."""
    prints = [F.col("print")[i].alias(f"p{i}") for i in range(PRINT_WORDS + 2)]
    listed = sets.select("id", "size", *prints, F.posexplode("prefix").alias("place", "key")).withColumn("place", F.col("place").cast("bigint"))
    names = ["id", "size", "place", *(f"p{i}" for i in range(PRINT_WORDS + 2))]
    links = links_by_key(listed, names, lambda a, b: may_be_similar(a, b, similarity), node=1)
    roots = components(materialize(fingerprint_links(sets).union(links), "family_links"))
    own = sets.select("id", "row", F.array("id").alias("u")).filter("id <> 0").join(roots, "u", "left")
    own = materialize(own.select("id", "row", F.coalesce("root", "u")[0].alias("family")), "families")
    sizes = own.groupBy("family").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return own.join(sizes, "family").select("id", "row", "family", "size")


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets are at least so similar (shared through all members), exactly."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for start in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, (start, start + 4096))
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[i:j], column[i:j] - start] = 1
        both += held @ held.T
    return both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9


def connecting(ok: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``ok`` that connect all that its pairs connect: a tree per group."""
    left, found = np.ones(len(ok), bool), []
    for first in range(len(ok)):
        if not left[first]:
            continue
        left[first], front = False, [first]
        while front:
            one = front.pop()
            hits = np.flatnonzero(ok[one] & left)
            left[hits] = False
            front.extend(hits.tolist())
            found.extend((one, hit) for hit in hits.tolist())
    return found


def _links_of(dealt: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that connect all pairs of sets at least so similar in every group of ``dealt`` (family, part, id, s)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []
        for batch in batches:
            family, part, names = (batch.column(i).to_numpy() for i in range(3))
            values, ends = batch.column(3).flatten().to_numpy(), np.cumsum(batch.column(3).value_lengths().to_numpy())
            for n in range(len(names)):
                if group != (family[n], part[n]):
                    yield from emit(ids, sets)
                    group, ids, sets = (family[n], part[n]), [], []
                ids.append(names[n])
                sets.append(values[ends[n - 1] if n else 0 : ends[n]].copy())
        yield from emit(ids, sets)

    def emit(ids: list, sets: list) -> Iterator[pa.RecordBatch]:
        found = connecting(similar(sets, similarity)) if len(ids) > 1 else []
        if found:
            sides = [pa.array([[ids[x]] for x in side], pa.list_(pa.int64())) for side in zip(*found)]
            yield pa.RecordBatch.from_arrays(sides, names=["u", "v"])

    grouped = dealt.select("family", F.col("part").cast("bigint").alias("part"), "id", "s").repartition("family", "part")
    return arrow_step(grouped.sortWithinPartitions("family", "part"), link, "u array<bigint>, v array<bigint>").distinct()


def _between(hashed: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """(family, part, id, s): groups in which all sets of a family meet that ``roots`` doesn't connect yet.

    A group of connected sets larger than ``block`` has blocks of its own, which needn't meet each other; the sets of smaller
    groups share blocks. A family that is connected as a whole has none.
    """
    named = hashed.select("id", "family", F.array("id").alias("u")).join(roots, "u", "left")
    named = materialize(named.select("id", "family", F.coalesce("root", "u")[0].alias("root")), "connected_sets")
    sizes = named.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes.withColumn("own", F.when(F.col("n") > block, F.col("root")).otherwise(0)), "connected_sizes")
    parts = sizes.groupBy("family", "own").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    family = Window.partitionBy("family")
    running = family.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("first", (F.sum("blocks").over(running) - F.col("blocks")).cast("int"))
    parts = parts.withColumn("all", F.sum("blocks").over(family).cast("int")).filter((F.col("own") == 0) | (F.col("blocks") < F.col("all")))
    placed = named.join(sizes.drop("n"), ["family", "root"]).join(parts, ["family", "own"])
    mine = (F.col("first") + F.pmod(F.xxhash64("id"), "blocks")).cast("int")
    met = F.filter(
        F.sequence(F.lit(0), F.col("all") - 1),
        lambda o: (F.col("own") == 0) | (o < F.col("first")) | (o >= F.col("first") + F.col("blocks")),
    )
    pairs = F.transform(met, lambda o: F.least(o, mine).cast("bigint") * F.col("all") + F.greatest(o, mine))
    return hashed.select("id", "s").join(placed.select("id", "family", pairs.alias("pairs")), "id").select("family", F.explode("pairs").alias("part"), "id", "s")


def similar_links(
    documents: DataFrame, members: DataFrame, *, words: int, seed: int, similarity: float, block: int = 128, hubs: int = 8,
) -> DataFrame:
    """(u, v): links between sets at least so similar, enough to connect all such pairs of every family.

    A family of up to ``block`` sets compares all its pairs. A larger one first compares the sets of each block, to which some
    ``hubs`` sets of the family are added; a family that this connects, like a group of near copies, is done, at a cost in
    proportion to its size. Otherwise each pair of blocks is compared that is not of one connected group.
    """
    texts = documents.select(F.xxhash64("area", "document").alias("row"), "document").join(members, "row")
    hashed = by_row(
        texts, "document", "s array<bigint>", lambda t: [[shingle_set(x, words, seed).view(np.int64) for x in t]], ["id", "family", "size"]
    )
    hashed = materialize(hashed, "member_sets")
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    hub = (blocks > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.col("size")) < hubs)
    dealt = hashed.select("family", F.explode(F.when(hub, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))).alias("part"), "id", "s")
    links = materialize(_links_of(dealt, similarity), "block_links")
    large = hashed.filter(F.col("size") > block)
    if large.isEmpty():
        return links
    within = links.join(large.select(F.array("id").alias("u")), "u", "left_semi")
    return links.union(_links_of(_between(large, components(within), block), similarity))


def near_copies(documents: DataFrame, *, words: int = 5, seed: int = 42, similarity: float = 0.8) -> DataFrame:
    """(area, row, id, component): every document (area, document) with the smallest area it is linked to.

    Two documents are linked if their sets of shingles have a Jaccard similarity of ``similarity`` or more, directly
    or through others; texts without a word are linked with each other. ``row`` is xxhash64(area, document). Rows
    with a null area take part but never name a component; one without any area gets null. Repeated rows repeat.
    """
    rows, sets = near_sets(documents, words=words, seed=seed, similarity=similarity)
    members = materialize(families(sets, similarity=similarity), "family_members")
    links = similar_links(documents, members, words=words, seed=seed, similarity=similarity)
    roots = components(materialize(links, "similar_links"))
    named = sets.select("id", "least", F.array("id").alias("u")).join(roots, "u", "left").select(
        "id", "least", F.coalesce("root", "u").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n"))
    merged = materialize(
        named.join(smallest.filter("n > 1"), "root").filter(~F.col("least").eqNullSafe(F.col("component")))
        .select("id", F.col("component").alias("other")), "merged_sets"
    )
    own = sets.select("id", "least").join(merged, "id", "left").select("id", F.coalesce("other", "least").alias("component"))
    return rows.join(own, "id").select("area", "row", "id", "component")
