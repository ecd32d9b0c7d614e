"""Toxicity by a linear classifier that is told to ignore which group a sentence mentions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embergrid.llm.records import arrow_step, by_row

SLOTS = 1 << 18

#: Identity terms in groups of alternatives, fixed values. A term is swapped for the next of its group.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mothers", "fathers"), ("she", "he"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "citizens", "natives"), ("african", "european", "american", "arab", "mexican", "chinese"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young"),
    ("frauen", "männer"), ("mujeres", "hombres"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("muslime", "christen", "juden"),
)
SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITIES for i, term in enumerate(group)}


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower()) if text else []


def features(words: list[str], known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Distinct hashed features of a text: its words and their beginnings of four and five letters."""
    from xxhash import xxh32_intdigest

    if len(known) > 400_000:
        known.clear()
    slots: set[int] = set()
    for w in set(words):
        own = known.get(w)
        if own is None:
            parts = {f"={w}", w[:4], w[:5]}
            own = known[w] = tuple(xxh32_intdigest(p.encode("utf-8", "surrogatepass")) % SLOTS for p in parts)
        slots.update(own)
    return np.fromiter(sorted(slots), np.int32, len(slots))


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the hashed features (fixed number), bias."""

    weights: np.ndarray
    bias: float


def _sums(w: np.ndarray, slots: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row of ragged slots."""
    total = np.concatenate([[0.0], np.cumsum(w[slots])])
    return total[starts + sizes] - total[starts]


def fit(rows: list[tuple[np.ndarray, np.ndarray | None, int]], *, rounds: int, sparsity: float, fairness: float) -> ToxicityModel:
    """Weights for (features, features with swapped terms or None, label) by proximal gradient steps.

    Loss: mean log loss, classes weighted alike, plus ``fairness`` times the mean squared difference of the log-odds of
    a text and its swapped form, plus ``sparsity`` times the absolute weights, which sets most of them to zero.
    """
    x = [r[0] for r in rows] + [r[1] for r in rows if r[1] is not None]
    label = np.array([r[2] for r in rows], float)
    pair = np.flatnonzero([r[1] is not None for r in rows])
    if not len(rows) or label.min() == label.max():
        return ToxicityModel(np.zeros(SLOTS, np.float32), -4.0 if not label.sum() else 4.0)
    sizes = np.array([len(v) for v in x])
    starts = np.cumsum(sizes) - sizes
    slots = np.concatenate(x)
    n = len(rows)
    balance = np.where(label == 1, n / (2 * label.sum()), n / (2 * (n - label.sum())))
    w, bias = np.zeros(SLOTS), 0.0
    square, bias_square = np.full(SLOTS, 1e-8), 1e-8
    for _ in range(rounds):
        margin = _sums(w, slots, starts, sizes) + bias
        error = np.zeros(len(x))
        error[:n] = balance * (1 / (1 + np.exp(-np.clip(margin[:n], -30, 30))) - label) / n
        if len(pair):
            apart = 2 * fairness * (margin[pair] - margin[n:]) / len(pair)
            error[pair] += apart
            error[n:] -= apart
        gradient = np.bincount(slots, np.repeat(error, sizes), SLOTS)
        square += gradient**2
        pace = 0.3 / np.sqrt(square)
        w = w - pace * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - pace * sparsity, 0)
        bias_square += error.sum() ** 2
        bias -= 0.3 * error.sum() / np.sqrt(bias_square)
    return ToxicityModel(w.astype(np.float32), float(bias))


def train_toxicity(
    documents: DataFrame, labels: DataFrame, *, sample_rows: int = 8000, rounds: int = 200, sparsity: float = 1e-3, fairness: float = 1.0,
) -> ToxicityModel:
    """Model from documents (area, document) and labels (area, toxic).

    Fitted on a bounded sample of labelled rows: about ``sample_rows`` at most, drawn by a hash of the area so that each
    class gives up to half. Rows without label or text teach nothing; labels without a document leave the sample smaller.
    Without both classes the score is constant. The sample's areas, few by that bound, go to the documents as a
    broadcast, so no text of another document moves.
    """
    marked = labels.filter("area is not null and toxic is not null").groupBy("area").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(sample_rows / 2 / n)) for k, n in sizes.items()], F.lit(0.0))
    chosen = marked.filter(F.pmod(F.xxhash64("area", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0 < share)
    drawn = (
        documents.select("area", "document").filter(F.col("document").isNotNull()).join(F.broadcast(chosen), "area")
        .select("document", "toxic").distinct()
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            own, swapped = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                other = [SWAP.get(w, w) for w in words]
                own.append(features(words, known))
                swapped.append(features(other, known) if other != words else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, kind), pa.array(swapped, kind), batch.column(1).cast(pa.int32())], names=["own", "swapped", "toxic"]
            )

    rows = arrow_step(drawn, extract, "own array<int>, swapped array<int>, toxic int").toArrow().to_pydict()
    ragged = [
        (np.array(a, np.int32), None if b is None else np.array(b, np.int32), y)
        for a, b, y in zip(rows["own"], rows["swapped"], rows["toxic"])
    ]
    ragged.sort(key=lambda r: (len(r[0]), r[0].tobytes()))  # the order of arrival must not matter
    return fit(ragged, rounds=rounds, sparsity=sparsity, fairness=fairness)


def score_toxicity(documents: DataFrame, model: ToxicityModel, *, keep: list[str] | None = None) -> DataFrame:
    """(area, score): how likely each document (area, document) is toxic, 0 to 1. Whole texts are read.

    Null and empty texts, and texts without a letter, get the score of no evidence. Repeated rows repeat, other columns
    than ``keep`` are left out. The weights, of fixed size, are sent to every task.
    """
    weights = documents.sparkSession.sparkContext.broadcast(model.weights)
    bias, state = model.bias, {}

    def run(texts: list) -> list[list]:
        w, known = weights.value, state
        out = []
        for text in texts:
            margin = float(w[features(words_of(text), known)].sum()) + bias
            out.append(float(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0)))))
        return [out]

    return by_row(documents, "document", "score double", run, keep or ["area"])
