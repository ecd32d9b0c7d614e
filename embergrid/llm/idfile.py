"""Token-id files: canonical length-limited Huffman codes from global counts, in independent blocks with checkpoints."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from embergrid.llm.records import arrow_step

MAX_BITS = 18
BLOCK_IDS = 1 << 20
CHECK_EVERY = 256
SLICE_BYTES = 8 << 20  # of texts that a task cuts at once
CALL_BYTES = 256 << 10  # of texts in one call of the library


# ids of texts -------------------------------------------------------------------------------------------------------


def _spans(sizes, most: int) -> Iterator[tuple[int, int]]:
    """First and last + 1 of neighbours with sizes of at most ``most`` together, or of one with more."""
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, last
        first = last


class ChunkIds(dict):
    """Ids of texts by a tokenizers file with a byte-level vocabulary; chunks are encoded once and remembered.

    A text is cut where the splitting of byte-level tokenizers cuts anyway: before white space, after a line end that stands
    alone, and between an ASCII letter or digit and an ASCII sign, so that a word is one chunk whatever sign follows it.
    Texts with white space beyond blanks, tabs and line ends go to the tokenizer whole, and so do those that contain the
    string of an added token, which the tokenizer finds before it splits.
    """

    LIMIT = 1_000_000
    ELSEWHERE = r"[\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    SPACE, LINE, WORD, SIGN = 1, 2, 4, 8

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character stands for a byte
        self._size[list(vocabulary.values())] = list(map(len, vocabulary))
        self._kind = np.zeros(256, np.uint8)
        for code in range(128):
            sign = self.WORD if chr(code).isalnum() else self.SIGN if chr(code).isprintable() else 0
            self._kind[code] = {" ": self.SPACE, "\t": self.SPACE, "\r": self.SPACE, "\n": self.SPACE | self.LINE}.get(chr(code), sign)
        self.clear()

    def clear(self) -> None:
        """Forget all chunks. Chunk number i has the ids from ``_first[i]`` up to ``_first[i + 1]``."""
        super().clear()
        self._held, self._first = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        made = []
        for first, last in _spans(list(map(len, texts)), CALL_BYTES):
            found = self._tokenizer.encode_batch_fast(texts[first:last], add_special_tokens=False)  # without offsets
            made += [np.array(e.ids, "<u4") for e in found]
        return made

    def _together(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of chunks that end in no white space, encoded in one text; their sizes tell where the ids of each lie."""
        apart = [c[:1].isspace() or b"\n" + c for c in chunks]  # a chunk that begins with white space is cut off anyway
        text = b"".join(c if a is True else a for c, a in zip(chunks, apart)).decode()
        size, line = np.array(list(map(len, chunks))), np.array([a is not True for a in apart])
        ends = np.cumsum(size + line)
        if not any(t in text for t in self._added):
            ids = self._ids([text])[0]
            reached = np.concatenate([[0], np.cumsum(self._size[ids])])
            first, last = np.searchsorted(reached, ends - size), np.searchsorted(reached, ends)
            if reached[-1] == ends[-1] and (reached[first] == ends - size).all() and (reached[last] == ends).all():
                return [ids[a:b] for a, b in zip(first.tolist(), last.tolist())]
        return self._ids([c.decode() for c in chunks])

    def _learn(self, chunks: list[bytes]) -> None:
        alone = [c for c in chunks if c[-1:].isspace()]
        rest = [c for c in chunks if not c[-1:].isspace()]
        made = self._ids([c.decode() for c in alone])
        for first, last in _spans(list(map(len, rest)), CALL_BYTES):
            made += self._together(rest[first:last])
        self.update(zip(alone + rest, range(len(self), len(self) + len(made))))
        self._held = np.concatenate([self._held, *made])
        self._first = np.append(self._first, self._first[-1] + np.cumsum(list(map(len, made)), dtype=np.int64))

    def _cut(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the chunks of joined texts begin; ``starts`` are the places of the texts."""
        kind = self._kind[raw]
        space, line = (kind & self.SPACE) > 0, (kind & self.LINE) > 0
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[2:] |= line[1:-1] & ~space[:-2] & ~space[2:]
        cut[1:] |= ((kind[:-1] & self.WORD) > 0) & ((kind[1:] & self.SIGN) > 0)
        cut[starts] = True
        return np.flatnonzero(cut)

    def _numbers(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The numbers of the chunks that begin at ``at``."""
        places = pa.py_buffer(np.append(at, len(raw)))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, places, pa.py_buffer(raw)]).dictionary_encode()
        found = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [c for c in found if c not in self]
        if fresh:
            self._learn(fresh)
        return np.array(list(map(self.__getitem__, found)), np.int64)[chunks.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text (null: none)."""
        if len(self) > self.LIMIT or len(self._held) > 16 * self.LIMIT:
            self.clear()
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.ELSEWHERE)
        for token in self._added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        whole = iter(self._ids(texts.filter(odd).to_pylist()))
        texts = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy()))
        if ends[-1]:
            base = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
            raw = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + ends[-1]]
            at = self._cut(raw, ends[:-1][ends[:-1] < ends[1:]])
            number = self._numbers(raw, at)
            size = self._first[number + 1] - self._first[number]
            reached = np.append(0, np.cumsum(size))
            ids = self._held[np.repeat(self._first[number] - reached[:-1], size) + np.arange(reached[-1])]
            ends = reached[np.searchsorted(at, ends)]
        else:
            ids = np.zeros(0, "<u4")
        return [next(whole) if o else ids[a:b] for o, a, b in zip(odd.to_pylist(), ends[:-1].tolist(), ends[1:].tolist())]


@cache
def _chunks(path: str) -> ChunkIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkIds(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of (area, document) with bounded bytes of text."""
    for first, last in _spans(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), SLICE_BYTES):
        yield batch.slice(first, last - first)


def tokenize(documents: DataFrame, tokenizer_path: str, *, end_id: int = 0) -> DataFrame:
    """(area, ids): ids of every document (area, document) and ``end_id``, as little-endian unsigned 16-bit numbers
    if all fit, else 32-bit; ``wide`` tells. Null and empty texts have the end id alone. Whole texts; rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            blobs, wide = [], []
            for ids in _chunks(tokenizer_path).encode(batch.column(1)):
                big = max(end_id, int(ids.max(initial=0))) > 0xFFFF
                blobs.append((ids if big else ids.astype("<u2")).tobytes() + end_id.to_bytes(4 if big else 2, "little"))
                wide.append(big)
            columns = [batch.column(0), pa.array(blobs, pa.binary()), pa.array(wide, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["area", "ids", "wide"])

    made = T.StructType([documents.schema["area"], *T._parse_datatype_string("ids binary, wide boolean")])
    return arrow_step(documents.select("area", "document"), run, made)


def _ids_of(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.int64)


# the code -----------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``max_bits`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need codes of more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        row = both[rank]
        is_leaf.append(rank < n)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        mine = int(flags[:take].sum())
        lengths[order[:mine]] += 1
        take = 2 * (take - mine)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id: what a decoder can rebuild from the lengths alone."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        code <<= size - before
        before = size
        ids = np.flatnonzero(lengths == size)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) for every value of the next ``bits`` bits."""
    bits = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (bits - lengths[used].astype(np.int64))
    ids, sizes = np.repeat(used, spans), np.repeat(lengths[used], spans)
    pad = (1 << bits) - len(ids)  # one id alone leaves half the table unused
    return np.pad(ids, (0, pad)).astype(np.int32), np.pad(sizes, (0, pad), constant_values=1).astype(np.int64), bits


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ids, most significant first, in big-endian 32-bit words; bit offset of every 256th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word, free = start >> 5, (64 - size - (start & 31)).astype(np.uint64)
    placed = codes[ids] << free
    n_words = int(end[-1] + 31 >> 5) + 1 if len(ids) else 0
    # codes fill disjoint bits of a word, so that adding is joining, and stays exact below 2^53
    words = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), n_words)
    words[1:] += np.bincount(word, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)[:-1]
    return words.astype(">u4").tobytes(), start[::CHECK_EVERY].astype(np.int64)


def unpack(payload: bytes, checks: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All ids of a block: every checkpoint is a lane, and the lanes go on together, one id a step."""
    ids, sizes, bits = table
    words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(CHECK_EVERY * bits // 32 + 3, np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at = checks.astype(np.int64)
    out = np.empty((CHECK_EVERY, len(at)), np.int32)
    last = len(pairs) - 1
    for step in range(min(CHECK_EVERY, n)):
        window = (pairs[np.minimum(at >> 5, last)] >> (64 - bits - (at & 31)).astype(np.uint64)) & np.uint64((1 << bits) - 1)
        window = window.astype(np.int64)
        out[step] = ids[window]
        at = at + sizes[window]
    return out.T.reshape(-1)[:n]


# files --------------------------------------------------------------------------------------------------------------


def id_counts(tokenized: DataFrame) -> DataFrame:
    """(id, n) over all documents: counted per task, then added; at most one row per id of the vocabulary and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids, wide = batch.columns
            for chosen, kind in ((wide, "<u4"), (pc.invert(wide), "<u2")):
                every = np.frombuffer(b"".join(ids.filter(chosen).to_pylist()), kind)
                for first in range(0, len(every), BLOCK_IDS):
                    one = np.bincount(every[first : first + BLOCK_IDS], minlength=len(total))
                    one[: len(total)] += total
                    total = one
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return arrow_step(tokenized.select("ids", "wide"), count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(tokenized: DataFrame, path: str, *, block_ids: int = BLOCK_IDS) -> None:
    """Write (area, ids, wide) under ``path``: ``lengths`` (id, bits) is the code, ``blocks`` the coded ids.

    Documents lie in ascending order of area (null first; repeated areas by their first ids) and are never split; rows that
    repeat an area are spread like any others. A block
    holds documents until ``block_ids`` ids are reached: its place (part, seq), the ids before it in its part, the areas and id
    counts of its documents, the bit offset of every 256th id, and the bits. A block is decoded without any other.
    """
    counted = id_counts(tokenized).collect()  # at most one row per id of the vocabulary
    counts = np.zeros(max((r["id"] for r in counted), default=-1) + 1, np.int64)
    for row in counted:
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    spark = tokenized.sparkSession
    used = np.flatnonzero(lengths)
    code = pa.table({"id": pa.array(used, pa.int64()), "bits": pa.array(lengths[used].astype(np.int64), pa.int64())})
    spark.createDataFrame(code).coalesce(1).write.parquet(f"{path}/lengths")
    shared = spark.sparkContext.broadcast(lengths)  # one byte per id of the vocabulary

    def code_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, codes = shared.value, canonical_codes(shared.value)
        part, seq, before, held, areas = TaskContext.get().partitionId(), 0, 0, [], []

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            payload, checks = pack(ids, size, codes)
            row = [part, seq, before, len(ids), areas, [len(h) for h in held], checks, payload]
            kinds = [pa.int64()] * 4 + [pa.list_(area_kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=BLOCK)

        area_kind = None
        for batch in batches:
            area_kind = batch.column(0).type
            for area, raw, wide in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(_ids_of(raw, wide))
                areas.append(area)
                if sum_of(held) >= block_ids:
                    yield block()
                    seq, before, held, areas = seq + 1, before + sum_of(held), [], []
        if held:
            yield block()

    def sum_of(arrays: list[np.ndarray]) -> int:
        return sum(map(len, arrays))

    kind = tokenized.schema["area"].dataType.simpleString()
    schema = f"part bigint, seq bigint, before bigint, n bigint, areas array<{kind}>, sizes array<bigint>, checks array<bigint>, payload binary"
    order = ["area", "begin", "row"]
    keyed = tokenized.select("area", "ids", "wide", F.substring("ids", 1, 16).alias("begin"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("area", "ids", "wide")
    arrow_step(dealt, code_blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")


BLOCK = ["part", "seq", "before", "n", "areas", "sizes", "checks", "payload"]


def read_ids(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """(area, start, n_tokens, ids_crc32) of every document in the files; ``with_ids`` adds ids as 32-bit bytes.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is that of the document's ids as little-endian
    unsigned 32-bit numbers. Files without documents: no row.
    """
    code = spark.read.parquet(f"{path}/lengths").collect()  # at most one row per id of the vocabulary
    lengths = np.zeros(max((r["id"] for r in code), default=-1) + 1, np.uint8)
    for row in code:
        lengths[row["id"]] = row["bits"]
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["areas"].dataType.elementType.simpleString()
    arrow_kind = to_arrow_type(blocks.schema["areas"].dataType.elementType)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in BLOCK}
                table = table or decoding_table(shared.value)
                ids = unpack(one["payload"].as_py(), one["checks"].values.to_numpy(), one["n"].as_py(), table).astype("<u4")
                sizes = one["sizes"].values.to_numpy()
                ends = np.cumsum(sizes)
                raws = [ids[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist())]
                columns = [
                    pa.array([one["part"].as_py()] * len(raws), pa.int64()), pa.array(one["areas"].as_py(), arrow_kind),
                    pa.array(one["before"].as_py() + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(r) for r in raws], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raws, pa.binary())] * with_ids, names=NAMES + ["ids"] * with_ids)

    made = f"part bigint, area {kind}, within bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    rows = arrow_step(blocks, decode, made)
    totals = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # one row per written file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").select("area", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


NAMES = ["part", "area", "within", "n_tokens", "ids_crc32"]
