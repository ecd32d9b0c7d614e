"""Importance resampling and shards against brute force."""

import math
import random
import re
from hashlib import md5, sha256
from zlib import crc32

import numpy as np

from embergrid.llm import resample, shards

DOCS = "area bigint, document string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def _buckets(text, buckets):
    w = _words(text)
    return [crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def _resampled(docs, targets, percent, least, seed, buckets):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d for _, d in docs]), (t, targets)):
        for text in texts:
            for b in _buckets(text, buckets):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for area, text in docs:
        b = _buckets(text, buckets)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(sha256(f"{seed}:{'' if area is None else area}".encode()).hexdigest()[:8], 16)
        rows.append((area, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(_words(text)) >= least))
    long = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = len(long) * percent // 100
    out = [(*r[:4], i if i <= drawn else None) for i, r in enumerate(long, 1)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=str)


def _texts(draw, n):
    pool = ["Fire", "fire", "éTÉ", "日本", "x1", "O'Neil", "a-b", "😀", "…", "\x00", "q" * 300]
    return [draw.choice((" ", "\n", "--", "\x7f")).join(draw.choices(pool, k=draw.choice((0, 1, 3, 12, 25, 60)))) for _ in range(n)]


def test_crc_of_joined_words_follows_from_payloads():
    draw = random.Random(1)
    parts = [(draw.randbytes(draw.randrange(40)), draw.randbytes(draw.choice((0, 1, 2, 7, 300, 70_000)))) for _ in range(200)]
    got = resample.joined_crc(
        np.array([crc32(a) for a, _ in parts], np.uint32), np.array([crc32(b) for _, b in parts], np.uint32), np.array([len(b) for _, b in parts])
    )
    assert got.tolist() == [crc32(a + b) for a, b in parts]


def test_features_equal_brute_force_across_parts(monkeypatch):
    monkeypatch.setattr(resample, "HITS", 7)  # pairs that reach over the end of a part
    texts = [None, *_texts(random.Random(2), 60), "", "one", "a " * 5000]
    found = {i: [] for i in range(len(texts))}
    for at, buckets in resample.scan_buckets(texts, 997):
        for i, b in zip(at.tolist(), buckets.tolist()):
            found[i].append(b)
    assert [sorted(found[i]) for i in found] == [sorted(_buckets(t, 997)) for t in texts]


def test_resampling_equals_brute_force(spark):
    draw = random.Random(3)
    docs = [(i, t) for i, t in enumerate(_texts(draw, 400))]
    docs += [(7, docs[9][1]), (7, docs[9][1]), (None, "w " * 30), (None, "w " * 30), (None, None), (500, None), (501, ""), (502, "long " * 60_000)]
    targets = ["fire été x1", "日本 fire fire", None, ""]
    df = spark.createDataFrame([(*d, "n", 1.0) for d in docs], DOCS + ", score string, rank double").repartition(6)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], DOCS)
    got = resample.resample(df, goal, percent=40, min_words=12, seed=5, buckets=499)
    assert got.columns == ["area", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _resampled(docs, targets, 40, 12, 5, 499)


def test_many_equal_rows_and_empty_tables(spark):
    docs = [(1, "w " * 30)] * 900 + [(i, f"a{i} " * 30) for i in range(2, 60)]
    df, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], DOCS)
    got = resample.resample(df, none, percent=50)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _resampled(docs, [], 50, 20, 7, 10_000)
    assert resample.resample(none, df).collect() == []


# ---- shards


def _sharded(docs, n, whole=0.05):
    """[(area, size, crc, shard, slot)] from one sort of all documents."""
    rows = sorted(
        (md5((t or "").encode()).hexdigest()[:15], a is not None, a or 0, i, a, len((t or "").encode()) + 1, crc32((t or "").encode()))
        for i, (a, t) in enumerate(docs)
    )
    total, upto, copies, first = sum(r[5] for r in rows), 0, {}, {}
    for r in rows:
        copies[r[0]] = copies.get(r[0], 0) + r[5]
        first.setdefault(r[0], upto)
        upto += r[5]
    out, upto, used = [], 0, {}
    for r in rows:
        upto += r[5]
        twice = 2 * first[r[0]] + copies[r[0]] if copies[r[0]] * n <= whole * total else 2 * upto - r[5]
        shard = min(n - 1, twice * n // (2 * total))
        out.append((r[4], r[5], r[6], shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + 1
    return sorted(out, key=str)


def _got(spark, docs, **how):
    df = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", shard int").repartition(5)
    rows = shards.shard_documents(df, **how).collect()
    assert {r.law for r in rows} <= {"bytes"}
    return sorted(((r.area, r.size, r.text_crc32, r.shard, r.slot) for r in rows), key=str)


def test_shards_equal_one_sort_and_are_nearly_even(spark):
    draw = random.Random(4)
    docs = [(i, "é" * draw.choice((0, 1, 40, 200))) if i % 5 == 0 else (i, f"{i} " * draw.randrange(1, 400)) for i in range(3000)]
    docs += [(None, None), (None, "a"), (None, "a"), (3, "b"), (3, "b"), (9000, "x" * 120_000)]
    got = _got(spark, docs, shards=16)
    assert got == _sharded(docs, 16)
    held = {}
    for _, size, _, shard, _ in got:
        held[shard] = held.get(shard, 0) + size
    share = sum(held.values()) / 16
    assert len(held) == 16 and max(abs(b - share) for b in held.values()) <= 0.05 * share + 120_000


def test_copies_stay_together_unless_there_are_too_many(spark):
    docs = [(i, f"{i} " * 50) for i in range(800)] + [(1000 + i, f"copy {i % 20} " * 30) for i in range(100)]
    hot = docs + [(5000 + i, "the hot text " * 12) for i in range(1200)] + [(7, "the same row " * 12)] * 600
    got = _got(spark, hot, shards=8, ranges_per_shard=64)
    assert got == _sharded(hot, 8)
    where = {}
    for _, _, crc, shard, _ in got:
        where.setdefault(crc, set()).add(shard)
    assert all(len(where[crc32((f"copy {i} " * 30).encode())]) == 1 for i in range(20))
    assert min(len(where[crc32((t * 12).encode())]) for t in ("the hot text ", "the same row ")) > 1
    assert shards.shard_documents(spark.createDataFrame([], DOCS)).collect() == []
    assert _got(spark, [(1, None)]) == [(1, 1, 0, 8, 0)] == _sharded([(1, None)], 16)


def test_ranges_of_keys():
    low = shards.LEAST
    cuts = shards.aligned([(5, 1, 1), (7, 2, 2), (7, 2, 9), (7, 4, 1), (9, 0, 0)])
    assert cuts == [(5, low, low), (7, low, low), (7, 2, 2), (7, 2, 9), (7, 4, 1), (8, low, low), (9, low, low)]
    draw = random.Random(5)
    keys = [(draw.randrange(4, 11), draw.choice((low, 1, 2, 3, 4, 5)), draw.randrange(12)) for _ in range(2000)]
    got = shards.range_of(cuts, *(np.array(c, np.int64) for c in zip(*keys)))
    assert got.tolist() == [sum(c <= k for c in cuts) for k in keys]
