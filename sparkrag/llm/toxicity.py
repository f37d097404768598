"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has a learning rate of its own, and the L1 term keeps the weight of a coordinate
at zero until its evidence outgrows it, so the weights are few and go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, add_column
from .labelled import held_out, sample_ids, with_text

SAMPLE = 30_000  # labelled rows that the model is fitted on at most
EPOCHS = 3
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.01
GROUP_WORDS = 1 << 20

# Places of single words, of neighbours, and of words with one other between them.
WORDS, PAIRS, SKIPS = 1 << 21, 1 << 20, 1 << 20
DIM = WORDS + PAIRS + SKIPS

# ASCII that is no letter or digit becomes a blank.
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode(errors="replace").translate(_WORD_BYTES).split()


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15) + b) ^ np.uint64(salt)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def features(hashes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the weight table, with the text of each, for the words of several texts."""
    yield owner, (hashes & np.uint64(WORDS - 1)).astype(np.int64)
    for gap, size, base in ((1, PAIRS, WORDS), (2, SKIPS, WORDS + PAIRS)):
        if len(hashes) > gap:
            inside = owner[gap:] == owner[:-gap]
            place = _mix(hashes[:-gap], hashes[gap:], gap) & np.uint64(size - 1)
            yield owner[:-gap][inside], place[inside].astype(np.int64) + base


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    held, n, first = [], 0, 0
    texts = batch.column("text").to_pylist()
    for i, text in enumerate(texts):
        held.append(words_of(text))
        n += len(held[-1])
        if n >= GROUP_WORDS or i == len(texts) - 1:
            yield first, held
            first, held, n = i + 1, [], 0


def _hashed(known: WordHashes, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    hashes = known.array([w for t in texts for w in t])
    return hashes, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _feature_batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in stream:
        for first, texts in _groups(batch):
            got = list(features(*_hashed(known, texts)))
            both = np.unique(np.concatenate([o * DIM + p for o, p in got]))
            cut = np.searchsorted(both, np.arange(len(texts) + 1) * DIM)
            places = (both % DIM).astype(np.int32)
            rows = [places[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            part = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.array(rows, pa.binary())],
                names=["doc_id", "label", "places"])


def ftrl(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Bias and weights after ``epochs`` passes in the given order."""
    z, n = np.zeros(DIM), np.zeros(DIM)
    bias, bias_n = 0.0, 0.0
    for _ in range(epochs):
        for label, at in rows:
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) <= L1, 0.0, (np.sign(za) * L1 - za)
                         / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - label
            z[at] = za + g - (np.sqrt(na + g * g) - root) / ALPHA * w
            n[at] = na + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    w = np.where(np.abs(z) <= L1, 0.0,
                 (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return float(bias), w


def _fit_batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(int(y), np.frombuffer(x, np.int32)) for batch in stream
            for y, x in zip(batch.column("label").to_pylist(), batch.column("places").to_pylist())]
    bias, w = ftrl(rows)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(w[at], bias), pa.float64())],
        names=["place", "weight"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights (place -1: bias) learned from ``labels(doc_id, toxic)``.

    Rows of the held-out fold and rows without label are never read.  The sample is bounded by
    ``sample`` rows: features are made in many tasks, the passes over them run in one, and the result
    has at most ``DIM`` weights.
    """
    ids = sample_ids(labels.where(~held_out(F.col("doc_id"))).where("toxic is not null")
                     .select("doc_id", F.col("toxic").cast("int").alias("label")), sample, 7)
    made = with_text(docs, ids).mapInArrow(
        _feature_batches, "doc_id long, label int, places binary")
    order = F.xxhash64(F.lit(8), "doc_id")
    got = (made.repartition(1).sortWithinPartitions(order, "doc_id")
           .mapInArrow(_fit_batches, "place int, weight double").toPandas())
    return got["place"].to_numpy(), got["weight"].to_numpy()


def _score_batches(place: np.ndarray, weight: np.ndarray, column: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        table = np.zeros(DIM, np.float32)
        table[place[place >= 0]] = weight[place >= 0]
        bias = weight[place < 0].sum()
        for batch in stream:
            scores = np.full(batch.num_rows, bias)
            for first, texts in _groups(batch):
                # A feature counts once per text; nearly all have no weight and go first.
                marks = []
                for owner, at in features(*_hashed(known, texts)):
                    some = np.flatnonzero(table[at])
                    marks.append(owner[some] * DIM + at[some])
                both = np.unique(np.concatenate(marks))
                scores[first:first + len(texts)] += np.bincount(
                    both // DIM, table[both % DIM].astype(np.float64), len(texts))
            scores = 1 / (1 + np.exp(-np.clip(scores, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], names=[*batch.schema.names, column])
    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray],
          column: str = "toxicity") -> DataFrame:
    """All columns of ``docs(text, ...)`` and the probability of toxicity, 0 to 1.

    Null and empty texts have no features and get the score of the bias.  A column of that name
    in the input is replaced.
    """
    return add_column(docs, column, T.DoubleType(), _score_batches(*model, column))
