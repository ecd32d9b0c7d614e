"""Byte-level BPE with a published rank file: exact merges by backtracking, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from embergrid.llm.records import by_row

REMEMBER = 300_000  # chunks and pieces that a worker keeps, and twice as many pairs of ids; some 150 MB


class ByteBpe:
    """Encoder of single pieces.

    Bytes are read as Latin-1 characters so that the automaton finds all vocabulary entries of a piece in one
    pass. The encoding of a byte string is the one sequence in which every two neighbours are compatible, that is
    in which they stay apart when merged as a pair; it is found by taking the longest entry and stepping back
    to shorter ones. Compatibility is kept in a table, and dead positions are marked, so each position is left
    at most once: the work is linear in the piece.
    """

    def __init__(self, ranks: dict[bytes, int], remember: int = REMEMBER):
        import ahocorasick

        self.ranks, self.remember = ranks, remember
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self.size_of = {i: len(b) for b, i in ranks.items()}
        self._shorter: dict[int, int] = {}
        self._split: dict[int, tuple[int, int]] = {}  # the two entries that an entry's last merge joins
        for raw, i in ranks.items():
            if len(raw) > 1 and len(parts := self.merge(raw, 2)) == 2:
                self._split[i] = (parts[0], parts[1])
        self._joined = {pair: i for i, pair in self._split.items()}
        self._above = max(self.bytes_of) + 1
        self._rising = all(max(pair) < i for i, pair in self._split.items())
        self.usable = {b: i for b, i in ranks.items() if len(b) == 1 or i in self._split}  # what merges can make
        self._widest = max(map(len, self.usable))
        self.automaton = ahocorasick.Automaton()
        for raw, i in self.usable.items():
            self.automaton.add_word(raw.decode("latin-1"), i)
        self.automaton.make_automaton()

    def merge(self, raw: bytes, enough: int = 1) -> list[int]:
        """The merges as defined: always the lowest-ranked neighbouring pair, leftmost first, until so many parts are left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > enough:
            found = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            found = [x for x in found if x[0] is not None]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 2 * self.remember:
                self._pairs.clear()
            known = self._pairs[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before those inside: these are undone, the latest first.

        Where every merge makes a higher rank than its parts have, merges happen in the order of ranks, equal ones from
        the left. So the pair at the border is merged if its rank is lower than that of the merge undone last, or
        equal and that one lies to the right.
        """
        if not self._rising:
            return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        split, joined, below = self._split, self._joined, self._above
        while True:
            if joined.get((left, right), below) < below:
                return False
            if left in split and (left > right or right not in split):
                below, left = left, split[left][1]
            elif right in split:
                below, right = right + 1, split[right][0]
            else:
                return True

    def forget(self) -> None:
        self._pairs.clear()
        self._shorter.clear()

    def shorter(self, i: int) -> int:
        """The longest entry that begins entry ``i`` and is shorter, or -1."""
        known = self._shorter.get(i)
        if known is None:
            raw = self.bytes_of[i]
            known = next((self.usable[raw[:k]] for k in range(len(raw) - 1, 0, -1) if raw[:k] in self.usable), -1)
            self._shorter[i] = known
        return known

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece; a piece that is an entry itself is that entry."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        text, n, pairs = raw.decode("latin-1"), len(raw), self._pairs
        greedy = [i for _, i in self.automaton.iter_long(text)]
        for pair in zip(greedy, greedy[1:]):
            if not (pairs[pair] if pair in pairs else self.compatible(*pair)):
                break
        else:
            return greedy
        sizes = self.size_of
        longest = dict(zip(accumulate(map(sizes.__getitem__, greedy), initial=0), greedy))
        dead, out, at = bytearray(n + 1), [], 0
        take = greedy[0]
        while at < n:
            while take >= 0:
                end = at + sizes[take]
                if not dead[end] and (not out or self.compatible(out[-1], take)):
                    out.append(take)
                    at = end
                    break
                take = self.shorter(take)
            else:
                dead[at] = 1
                last = out.pop()
                at -= sizes[last]
                take = self.shorter(last)
                continue
            if at < n:
                if at not in longest:  # a scan reads its text from the beginning, so it gets no more than one entry needs
                    longest[at] = next(self.automaton.iter_long(text[at : at + self._widest]))[1]
                take = longest[at]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TextEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; remembers chunks, and forgets all when full.

    A text is cut at single blanks and line ends that stand between two other characters. No match of
    the splitting pattern crosses such a place, so chunks are encoded independently and repeats are looked up.
    """

    def __init__(self, pattern: str, encode_pieces, remember: int = REMEMBER):
        import regex

        super().__init__()
        self._remember = remember
        self._find = regex.compile(pattern).findall
        self._crowded = regex.compile(r"\s\s|\x00|^\s|\s$").search
        self._encode = encode_pieces

    def __missing__(self, chunk: str) -> bytes:
        made = self._encode(self._find(chunk)) if chunk else b""
        self[chunk] = made
        return made

    def encode(self, text: str) -> bytes:
        if len(self) > self._remember:
            self.clear()
        if self._crowded(text):
            return self._encode(self._find(text))
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


@cache
def encoder(ranks_path: str, pattern: str, remember: int = REMEMBER) -> tuple[TextEncoder, list[bytes], Callable[[], None]]:
    """One per Python worker: the encoder, the bytes of each id, and how to forget what has been remembered."""
    bpe = ByteBpe(read_ranks(ranks_path), remember)
    table = [bpe.bytes_of.get(i, b"") for i in range(max(bpe.bytes_of) + 1)]
    packed = [i.to_bytes(4, "little") for i in range(len(table))]
    known: dict[str, bytes] = {}

    def pieces(found: list[str]) -> bytes:
        if len(known) > remember:
            known.clear()
        for p in found:
            if p not in known:
                known[p] = b"".join([packed[i] for i in bpe.piece(p.encode())])
        return b"".join([known[p] for p in found])

    def forget() -> None:
        for held in (chunks, known, bpe):
            (held.forget if held is bpe else held.clear)()

    chunks = TextEncoder(pattern, pieces, remember)
    return chunks, table, forget


def _forget(ranks_path: str, pattern: str, remember: int = REMEMBER) -> Callable[[], None]:
    """For the end of a task: a worker outlives its stage, and what it remembers would stand beside the next stage's memory."""
    return lambda: encoder(ranks_path, pattern, remember)[2]()


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, *, keep: list[str] | None = None) -> DataFrame:
    """(area, ids): ids of each document (area, document) as little-endian unsigned 32-bit bytes, the whole text.

    Null and empty texts have no ids (empty bytes). Texts of any length are taken whole, each match of ``pattern``
    on its own. Repeated rows repeat; columns other than ``keep`` are left out. ``ranks_path`` is a vocabulary
    file present on every machine.
    """

    def run(texts: list) -> list[list]:
        encode = encoder(ranks_path, pattern)[0].encode
        return [[encode(t) if t else b"" for t in texts]]

    return by_row(documents, "document", "ids binary", run, keep or ["area"], release=_forget(ranks_path, pattern))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, *, keep: list[str] | None = None) -> DataFrame:
    """(area, raw): the bytes that the ids of each row (area, ids) stand for. Null ids decode to empty bytes."""

    def run(blobs: list) -> list[list]:
        table = encoder(ranks_path, pattern)[1]
        return [[b"".join(map(table.__getitem__, np.frombuffer(b or b"", "<u4").tolist())) for b in blobs]]

    return by_row(encoded, "ids", "raw binary", run, keep or ["area"])


def encode_and_check(
    documents: DataFrame, ranks_path: str, pattern: str, *, keep: list[str] | None = None, with_ids: bool = False, remember: int = REMEMBER,
) -> DataFrame:
    """(area, n_tokens, ids_sha256, decoded_sha256): both steps in one pass over the texts, digests of their results.

    ``with_ids`` adds ``ids``; ``remember`` bounds what a worker keeps of words it has seen. Same cases as :func:`encode_documents`.
    """

    def run(texts: list) -> list[list]:
        coder, table, _ = encoder(ranks_path, pattern, remember)
        out: list[list] = [[], [], [], []]
        for text in texts:
            blob = coder.encode(text) if text else b""
            ids = np.frombuffer(blob, "<u4").tolist()
            decoded = b"".join(map(table.__getitem__, ids))
            row = (len(ids), hashlib.sha256(blob).hexdigest(), hashlib.sha256(decoded).hexdigest(), blob)
            for column, value in zip(out, row):
                column.append(value)
        return out if with_ids else out[:3]

    produced = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return by_row(documents, "document", produced, run, keep or ["area"], release=_forget(ranks_path, pattern, remember))
