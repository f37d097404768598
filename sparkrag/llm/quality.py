"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted documents are the positives, web text without labels is the rest.  With the share ``prior``
of good documents in the rest, the risk of a scorer is that of the positives, weighted by the
prior, plus what the unlabelled text has left as negative risk; that part can't be negative in truth,
so steps that would make it so are undone.  The prior is estimated from the same two samples.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, add_column, texts_of, window_hashes
from .labelled import held_out, sample_ids, with_text

SAMPLE = 12_000  # positives, and as many unlabelled texts, that the model is fitted on at most
THRESHOLD = 0.7
BINS = 12
STEPS = 1500
RATE, DECAY = 0.03, 1e-4
TOLERANCE = 0.0  # negative risk below minus this is pushed back

FEATURES = ("upper", "marks", "digits", "word bytes", "repeated neighbours", "distinct runs",
            "bars", "shouts", "signs", "short words", "longest word", "words", "line feeds",
            "clean ends", "commonest word", "distinct words")

_BYTE = np.arange(256)
_LETTER = np.array([c >= 0x80 or chr(c).isalpha() for c in range(256)])
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_DIGIT = (_BYTE >= 0x30) & (_BYTE <= 0x39)
_MARK = (_BYTE > 0x20) & (_BYTE < 0x7F) & ~_LETTER & ~_DIGIT
_SIGN = np.isin(_BYTE, list(b"#$%&*@^~<>={}[]\\_+"))
_CLEAN_END = frozenset(i for i in range(256) if _LETTER[i] or _DIGIT[i] or i in b".,;:?!'\")")


def measures(text: bytes | None, known: WordHashes) -> list[float]:
    """Shape of a text: none of the numbers depends on which words it holds."""
    text = text or b""
    raw = np.frombuffer(text, np.uint8)
    counts = sum((np.bincount(raw[i:i + (1 << 20)], minlength=256)
                  for i in range(0, len(raw), 1 << 20)), np.zeros(256, np.int64))
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    letters = max(1, int(counts[_LETTER].sum()))
    lengths = list(map(len, words)) or [0]
    hashes = known.array(words)
    runs = window_hashes(hashes, 4)
    common = Counter(words).most_common(1)
    return [
        counts[_UPPER].sum() / letters, counts[_MARK].sum() / size, counts[_DIGIT].sum() / size,
        sum(lengths) / n, np.count_nonzero(hashes[1:] == hashes[:-1]) / n,
        len(np.unique(runs)) / max(1, len(runs)), counts[0x7C] / n, counts[0x21] / n,
        counts[_SIGN].sum() / n, sum(x <= 3 for x in lengths) / n, max(lengths), np.log1p(len(words)),
        counts[0x0A] / n, sum(w[-1] in _CLEAN_END for w in words) / n,
        (common[0][1] if common else 0) / n, len(set(words)) / n ** 0.9]


def _measure_batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in stream:
        rows = [measures(t, known) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("positive"), pa.array(rows, pa.list_(pa.float64()))],
            names=["positive", "measures"])


class Model:
    """A weight for every bin of every measure, and the prior it was fitted with."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right")
                         for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.bias + sum(self.weights[j, b[:, j]] for j in range(b.shape[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _descend(model: Model, p: np.ndarray, u: np.ndarray, gradient) -> None:
    """Adam over the weights of the bins; ``gradient`` gives the slope at each margin."""
    width = model.weights.size
    at = np.arange(p.shape[1]) * model.weights.shape[1]
    p, u = p + at, u + at
    w, b = model.weights.reshape(-1).copy(), model.bias
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        gp, gu = gradient(b + w[p].sum(1), b + w[u].sum(1))
        g = np.append(np.bincount(p.ravel(), np.repeat(gp, p.shape[1]), width)
                      + np.bincount(u.ravel(), np.repeat(gu, u.shape[1]), width) + DECAY * w,
                      gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model.weights, model.bias = w.reshape(model.weights.shape), float(b)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from margins that tell the two samples apart.

    Above any cut the unlabelled hold at least prior times the share that the positives have
    there; where only positives are left both sides meet.  The smallest quotient over cuts with a
    third of the positives and more, with a margin for chance, is the estimate.
    """
    cuts = np.quantile(positive, np.linspace(0, 2 / 3, 60))
    p = (positive[:, None] >= cuts).mean(0)
    u = (unlabelled[:, None] >= cuts).mean(0)
    chance = np.sqrt(u * (1 - u) / max(1, len(unlabelled)))
    return float(np.clip((u + chance) / p, 0.02, 0.99).min())


def fit_samples(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """nnPU on two bounded samples of measures."""
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.arange(1, BINS) / BINS, axis=0).T
    edges = np.concatenate([edges, np.quantile(both, [0.005, 0.02, 0.98, 0.995], axis=0).T], axis=1)
    edges = np.sort(edges, axis=1)
    blank = lambda: np.zeros((both.shape[1], edges.shape[1] + 1))
    apart = Model(edges, blank(), 0.0, 0.5)
    p, u = apart.bins(positive), apart.bins(unlabelled)
    n_p, n_u = len(p), len(u)
    # Told apart on one half, the prior read from the other (a single row is in both).
    _descend(apart, p[::2], u[::2], lambda a, b: ((_sigmoid(a) - 1) / n_p, _sigmoid(b) / n_u))
    prior = estimate_prior(apart.margin(positive[min(1, n_p - 1)::2]),
                           apart.margin(unlabelled[min(1, n_u - 1)::2]))
    model = Model(edges, blank(), 0.0, prior)

    def gradient(a, b):
        rest = np.logaddexp(0, b).mean() - prior * np.logaddexp(0, a).mean()
        negative_p, negative_u = -prior * _sigmoid(a) / n_p, _sigmoid(b) / n_u
        if rest < -TOLERANCE:
            return -negative_p, -negative_u
        return prior * (_sigmoid(a) - 1) / n_p + negative_p, negative_u

    _descend(model, p, u, gradient)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from positives of ``labels(doc_id, quality)`` and documents with their labels hidden.

    Positives are rows with quality 1 outside the held-out fold; negatives are never read.  The
    unlabelled are a sample of all documents outside that fold, labelled or not, so that it does not
    matter how many have labels.  Each sample has at most ``sample`` rows; only their measures
    reach the driver.  Without positives the score is the same for all texts.
    """
    usable = ~held_out(F.col("doc_id"))
    good = sample_ids(labels.where(usable & (F.col("quality") == 1)).select("doc_id"), sample, 11)
    free = sample_ids(docs.select("doc_id").where(usable), sample, 12)
    ids = good.withColumn("positive", F.lit(1)).unionAll(free.withColumn("positive", F.lit(0)))
    got = with_text(docs, ids).mapInArrow(
        _measure_batches, "positive int, measures array<double>").toPandas()
    x = np.array(got["measures"].to_list(), float).reshape(-1, len(FEATURES))
    y = got["positive"].to_numpy() == 1
    order = np.lexsort(x.T[::-1])  # whatever order the tasks came in
    order = np.random.default_rng(5).permutation(order)
    x, y = x[order], y[order]
    if y.all() or not y.any():
        return Model(np.zeros((len(FEATURES), 1)), np.zeros((len(FEATURES), 2)), 1.0, 0.5)
    return fit_samples(x[y], x[~y])


def _score_batches(model: Model, column: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in stream:
            x = np.array([measures(t, known) for t in texts_of(batch)], float)
            scores = model.score(x.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], names=[*batch.schema.names, column])
    return run


def score(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """All columns of ``docs(text, ...)`` and the probability of good quality, 0 to 1.

    Null and empty texts are scored as texts without words.  A column of that name is replaced.
    """
    return add_column(docs, column, T.DoubleType(), _score_batches(model, column))
