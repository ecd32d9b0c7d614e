"""Importance resampling of analysis documents towards a target set, by hashed runs of words.

Words are found by an Aho-Corasick automaton over the distinct words of a group of texts, each bounded by delimiters and carrying
its CRC-32 and its length. The CRC of two adjacent words follows from their payloads alone, so no pair of words is ever hashed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from embergrid.llm.records import arrow_step, by_row
from embergrid.session import materialize

GROUP_BYTES = 4 << 20  # texts scanned with one dictionary
HITS = 1 << 20  # words held at once
DELIMITER = b" "

# 0-9, a-z and whatever is not ASCII make words; A-Z become a-z, all else a delimiter
_BOUNDED = bytes(b if b >= 128 or chr(b).isalnum() else DELIMITER[0] for b in bytes(range(256)).lower())


def _zero_byte_tables() -> np.ndarray:
    """[k, j, b]: what the CRC register b << 8j becomes after 2^k zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    values = np.arange(256, dtype=np.uint32)
    one = np.stack([table, *(values << np.uint32(8 * (j - 1)) for j in (1, 2, 3))])
    powers = [one]
    for _ in range(30):
        powers.append(_after(powers[-1], powers[-1]))
    return np.stack(powers)


def _after(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC registers after as many zero bytes as ``tables`` (4, 256) stand for."""
    b = np.uint32(255)
    return tables[0][crc & b] ^ tables[1][crc >> 8 & b] ^ tables[2][crc >> 16 & b] ^ tables[3][crc >> 24]


_TABLES = _zero_byte_tables()


def joined_crc(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of left + right from both CRCs and the length of the right part."""
    out = left.copy()
    for k in range(int(right_bytes.max(initial=0)).bit_length()):
        here = (right_bytes >> k & 1).astype(bool)
        out[here] = _after(_TABLES[k], out[here])
    return out ^ right


def scan_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, CRC-32, bytes) of every word in order, some ``HITS`` words at a time. Null counts as empty."""
    from ahocorasick import Automaton

    plain = [(t or "").encode("utf-8", "surrogatepass").translate(_BOUNDED) for t in texts]
    words = {w for d in plain for w in d.split(DELIMITER)} - {b""}
    if not words:
        return
    dictionary = Automaton()
    for w in words:
        dictionary.add_word(f" {w.decode('latin-1')} ", crc32(w) | len(w) << 32)
    dictionary.make_automaton()
    ends = np.cumsum([len(d) + 1 for d in plain])  # of the delimiter that follows each text
    hits = dictionary.iter((DELIMITER + DELIMITER.join(plain) + DELIMITER).decode("latin-1"))
    while len(part := np.fromiter(islice(hits, HITS), [("end", np.int64), ("payload", np.int64)])):
        payload = part["payload"]
        yield np.searchsorted(ends, part["end"]), (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32


def scan_buckets(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, bucket) of every word and of every two adjacent words of a text, repeats included."""
    space = np.array([crc32(DELIMITER)], np.uint32)
    held = None  # the last word seen: it may have a neighbour in the next part
    for text, crc, size in scan_words(texts):
        yield text, (crc % buckets).astype(np.int64)
        if held is not None:
            text, crc, size = (np.r_[h, x] for h, x in zip(held, (text, crc, size)))
        pair = np.flatnonzero(text[1:] == text[:-1])
        first = joined_crc(crc[pair], space, np.ones(len(pair), np.int64))
        yield text[pair], (joined_crc(first, crc[pair + 1], size[pair + 1]) % buckets).astype(np.int64)
        held = text[-1:], crc[-1:], size[-1:]


def _grouped(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Whole texts in runs of some ``GROUP_BYTES``."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t or "")
        if held >= GROUP_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def bucket_counts(documents: DataFrame, *, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): features per bucket over all documents; a task sends each bucket once, however many texts it read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            for group in _grouped(batch.column(0).to_pylist()):
                for _, found in scan_buckets(group, buckets):
                    total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counted = arrow_step(documents.select("document"), run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, targets: DataFrame, *, buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to document frequency per bucket, rounded down.

    What comes to the driver is one number per bucket and table.
    """
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for counts, table in ((s, documents), (t, targets)):
        for row in bucket_counts(table, buckets=buckets).collect():
            counts[row["bucket"]] = row["n"]
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    ratio = [float((b + 1) * all_s) / float((a + 1) * all_t) for a, b in zip(s.tolist(), t.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def importance(documents: DataFrame, gains: np.ndarray, *, keep: list[str] | None = None) -> DataFrame:
    """(keep..., n_features, weight): number of features and the floored mean of their gains, 0 without a feature."""
    buckets = len(gains)

    def run(texts: list) -> list[list]:
        out: list[list] = [[], []]
        for group in _grouped(texts):
            n, total = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
            for text, found in scan_buckets(group, buckets):
                n += np.bincount(text, minlength=len(group))
                # sums of whole numbers below 2^53 are exact in doubles
                total += np.bincount(text, weights=gains[found], minlength=len(group)).astype(np.int64)
            out[0] += n.tolist()
            out[1] += (total // np.maximum(n, 1)).tolist()
        return out

    return by_row(documents, "document", "n_features bigint, weight bigint", run, keep or ["area"])


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable fixed by a key, rounded down."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((drawn.cast("double") + 0.5) / 4294967296.0)))


def resample(
    documents: DataFrame, targets: DataFrame, *, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = 10_000,
) -> DataFrame:
    """(area, n_features, weight, score, rank): analysis documents (area, document) drawn to resemble the target ones.

    Features are words (lower-cased, ASCII letters only; digits and whatever is not ASCII belong to words) and pairs of
    adjacent words, hashed by CRC-32 into ``buckets``. A document's weight is the floored mean over its features of the bucket's
    gain, from counts over all documents and all targets; its score adds noise fixed by seed and area, so the best
    scores are a draw without replacement by weight. ``percent`` of the documents with at least ``min_words`` words, rounded
    down, get rank 1, 2, 3 ... by score, ties to the smaller area (a null area first); all others a null rank.

    Null and empty texts have no feature and weight 0. Rows with a null area share one noise. Repeated rows are counted,
    scored and ranked each. Very long texts are scanned whole, in parts of bounded size. Empty documents: no row; empty targets:
    all counts of the target are 0. Other columns are left out, whatever their names.
    """
    gains = bucket_gains(documents, targets, buckets=buckets)
    scored = importance(documents, gains).withColumns({
        "score": F.col("weight") + noise(F.col("area"), seed),
        "short": F.col("n_features") < 2 * min_words - 1,  # w words have 2w - 1 features
        "row": F.monotonically_increasing_id(),  # parts rows that repeat
    })
    scored = materialize(scored, "scored")
    order = ["short", F.desc("score"), F.asc_nulls_first("area"), "row"]
    ordered = materialize(
        scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered"
    )
    part = F.shiftright("at", 33)  # a row's place is its partition's start plus its place there
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("short")).alias("drawable"))
    everywhere = Window.partitionBy(F.lit(1))  # one row per partition
    starts = materialize(sizes.select(
        "part", (F.sum("n").over(everywhere.orderBy("part")) - F.col("n")).alias("start"),
        F.floor(F.sum("drawable").over(everywhere) * percent / 100).alias("drawn"),
    ), "starts")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ordered.withColumn("part", part).join(starts, "part").select(
        "area", "n_features", "weight", "score", F.when(~F.col("short") & (rank <= F.col("drawn")), rank).alias("rank")
    )
