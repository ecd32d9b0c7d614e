"""Byte-level BPE and token-id files against the public libraries; pure parts against brute force."""

import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from embergrid.llm import bytebpe, idfile
from embergrid.llm.queries import RANKS, TOKENIZER

PATTERN = public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "Lowland fires near 12.5°N, 3.2°W.", "  two  blanks\n\n and\tlines \n", "Côte d'Ivoire’s état: 42 feux",
    "日本の火災 😀😀", "\x00null\x00", "a" * 5000, "ab " * 20000, "<|endoftext|> is text", "a <|endoftext|> b", "x<|endoftext|>y\nz", "\x85x\x1cy z", " lead", "trail ",
]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_merges(text):
    ids = np.frombuffer(bytebpe.encoder(RANKS, PATTERN)[0].encode(text), "<u4").tolist()
    reference = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={}) if not hasattr(
        test_encoder_equals_the_merges, "made") else test_encoder_equals_the_merges.made
    test_encoder_equals_the_merges.made = reference
    assert ids == reference.encode_ordinary(text)


@cache
def _bpe():
    return bytebpe.ByteBpe(bytebpe.read_ranks(RANKS))


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_backtracking_equals_merging_any_bytes(raw):
    bpe = _bpe()
    assert bpe.piece(raw) == ([bpe.ranks[raw]] if raw in bpe.ranks else bpe.merge(raw))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 50255), st.integers(0, 50255), st.integers(1, 12))
def test_neighbours_stay_apart_as_merging_tells(left, right, at):
    bpe = _bpe()
    raw = bpe.bytes_of[left] + bpe.bytes_of[right]
    for pair in ((left, right), (left, left), tuple(bpe.usable.get(x, left) for x in (raw[:at], raw[at:]))):
        assert bpe.compatible(*pair) == (bpe.merge(b"".join(map(bpe.bytes_of.get, pair))) == list(pair))


def test_a_long_word_is_not_read_again_and_again(monkeypatch):
    import random

    class Counting:
        read = 0

        def iter_long(self, text, *start):
            Counting.read += len(text)
            return scan(text, *start)

    bpe = _bpe()
    scan = bpe.automaton.iter_long
    monkeypatch.setattr(bpe, "automaton", Counting())
    word = "".join(random.Random(6).choices("etaoinshrdlu", k=30_000)).encode()
    ids = bpe.piece(word)
    assert b"".join(map(bpe.bytes_of.get, ids)) == word and Counting.read < 100 * len(word)


def test_encode_and_decode_tables(spark, plain):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2), (None, "no name", 3)]
    df = spark.createDataFrame(rows, "area bigint, document string, ids int")  # a clashing extra column
    encoded = bytebpe.encode_documents(df, RANKS, PATTERN)
    raw = bytebpe.decode_documents(encoded, RANKS, PATTERN).collect()
    assert sorted((r.raw.decode(), r.area is None) for r in raw) == sorted((t or "", a is None) for a, t, _ in rows)
    for r in encoded.collect():
        want = "no name" if r.area is None else TEXTS[r.area] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(want)
    assert bytebpe.encode_and_check(df.limit(0), RANKS, PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000), st.integers(9, 18))
def test_pack_and_unpack(ids, bits):
    ids = np.array(ids, np.int64)
    lengths = idfile.code_lengths(np.bincount(ids), bits)
    assert lengths.max() <= bits and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    payload, checks = idfile.pack(ids, lengths, idfile.canonical_codes(lengths))
    assert (idfile.unpack(payload, checks, len(ids), idfile.decoding_table(lengths)) == ids).all()


def test_lengths_are_optimal_and_limited():
    def huffman(counts):  # textbook: total bits without a limit
        import heapq

        heap, total = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        return total

    counts = np.random.default_rng(3).zipf(1.4, 500).clip(1, 10**6)
    assert (idfile.code_lengths(counts, 30) * counts).sum() == huffman(counts.tolist())
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    short = idfile.code_lengths(fib, 5)
    assert short.max() == 5 and (2.0 ** -short.astype(float)).sum() == 1
    with pytest.raises(ValueError):
        idfile.code_lengths(np.ones(9), 3)


@pytest.mark.parametrize("block_ids", [3, 1 << 20])
def test_token_files_round_trip(spark, tmp_path, block_ids):
    rows = [(len(TEXTS) - i, t, 0) for i, t in enumerate(TEXTS)] + [(5, "twice", 0), (5, "again", 0), (None, "no name", 0)]
    df = spark.createDataFrame(rows, "area bigint, document string, start int").repartition(5)
    idfile.write_ids(idfile.tokenize(df, TOKENIZER), f"{tmp_path}/f", block_ids=block_ids)
    got = idfile.read_ids(spark, f"{tmp_path}/f", with_ids=True).collect()
    reference = Tokenizer.from_file(TOKENIZER)  # its own way with special tokens: found in a text, they are ids
    want = sorted(np.array(reference.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for _, t, _ in rows)
    assert sorted(bytes(r.ids) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4 for r in got)
    before = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == before
        before += r.n_tokens
    assert [r.area for r in sorted(got, key=lambda r: r.start)] == sorted((a for a, _, _ in rows), key=lambda a: (a is not None, a or 0))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="ab1é日.,'s& \n\t\r\x85\u3000\u0301", max_size=30)), min_size=1, max_size=8))
def test_cut_texts_have_the_ids_of_whole_texts(texts):
    import pyarrow as pa

    reference = _tokenizer()
    got = idfile._chunks(TOKENIZER).encode(pa.array([None, *texts], pa.string())[1:])
    assert [ids.tolist() for ids in got] == [reference.encode(t or "", add_special_tokens=False).ids for t in texts]


@cache
def _tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def test_a_word_is_encoded_once_whatever_sign_follows_it(monkeypatch):
    import pyarrow as pa

    sent = []
    coder = idfile.ChunkIds(TOKENIZER)
    monkeypatch.setattr(coder, "_ids", lambda texts, ids=coder._ids: sent.extend(texts) or ids(texts))
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in "nrst"]
    texts = [" ".join(w + sign for w in words) for sign in ("", ".", ",", ";", "!!", "&&&", "'s", " -", "\n\n")]
    got = coder.encode(pa.array(texts))
    assert [ids.tolist() for ids in got] == [_tokenizer().encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(map(len, sent)) < 3 * len(texts[0])


def test_no_documents_give_empty_files(spark, tmp_path):
    df = spark.createDataFrame([], "area bigint, document string")
    idfile.write_ids(idfile.tokenize(df, TOKENIZER), f"{tmp_path}/f")
    assert idfile.read_ids(spark, f"{tmp_path}/f").count() == 0


def test_a_long_word_takes_linear_time():
    import random
    import time

    draw = random.Random(6)
    word = "".join(draw.choices("etaoinshrdluéß", k=200_000))
    coder = bytebpe.encoder(RANKS, PATTERN)[0]
    coder.encode("warm up the tables " * 50)
    began = time.process_time()
    ids = np.frombuffer(coder.encode(word), "<u4").tolist()
    took = time.process_time() - began
    reference = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    assert ids == reference.encode_ordinary(word) and took < 3


def test_ids_of_any_kind_and_many_rows_of_one_id(spark, tmp_path):
    for kind, make in (("smallint", int), ("string", str), ("date", lambda i: __import__("datetime").date(2020, 1, 1 + i))):
        df = spark.createDataFrame([(make(i), f"text {i}") for i in range(5)], f"area {kind}, document string")
        idfile.write_ids(idfile.tokenize(df, TOKENIZER), f"{tmp_path}/{kind}")
        assert [r.area for r in idfile.read_ids(spark, f"{tmp_path}/{kind}").orderBy("start").collect()] == [make(i) for i in range(5)]
    df = spark.range(0, 4000).selectExpr("if(id % 2 = 0, 7L, if(id % 3 = 0, null, id)) as area", "'the same words' as document")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    try:
        idfile.write_ids(idfile.tokenize(df, TOKENIZER), f"{tmp_path}/hot", block_ids=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{tmp_path}/hot/blocks").groupBy("part").agg({"n": "sum"}).agg({"sum(n)": "max"}).first()[0] < 4 * 2000
    got = [r.area for r in idfile.read_ids(spark, f"{tmp_path}/hot").orderBy("start").collect()]
    assert got == sorted((r.area for r in df.collect()), key=lambda a: (a is not None, a or 0))
