"""Benchmark decontamination as a prefix-filtered set join with exact verification.

Every window of a benchmark item is a set of word shingles that a document has to contain whole.
For a required containment of 1 the necessary prefix of a set is its rarest shingle alone, with
rarity counted over all documents.  Documents are probed with these prefix shingles; where one
occurs, its offset inside the window fixes where the window has to start, windows that would
leave the text go (length and position bound), and the words of the rest are compared one by one.

Only benchmark data is sent to the tasks, in blocks of bounded size: a larger benchmark takes more
passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stage import staged
from .common import WordHashes, add_column, batches, texts_of, window_hashes

WINDOW = 13
SHINGLE = 5
BLOCK_BYTES = 8 << 20  # benchmark text that one pass over the documents carries
GROUP_WORDS = 1 << 20  # document words that a task probes at once
COLUMN = "contamination"

_FILTER_BITS = 22
_COUNTS = pa.schema([("hash", pa.int64()), ("n", pa.int64())])
_MARK = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                   ("items", pa.list_(pa.string())), ("hits", pa.binary())])
MARK_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", T.BinaryType())])

# Lower-cases A-Z; all that no word holds becomes a blank.
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c
                    if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
                    for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return (text or b"").translate(_WORD_BYTES).split()


class Index:
    """Windows of one benchmark block, with the shingles of each shingle size."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, shingle: int):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.window, self.shingle = window, shingle
        known = WordHashes()
        self.hashes = [known.array(w) for w in self.words]
        self.sizes = sorted({min(shingle, len(w)) for w in self.words if w})
        self.filters: dict[int, np.ndarray] = {}
        self.prefixes: dict[int, tuple[np.ndarray, ...]] = {}

    def _of_size(self, size: int):
        for i, h in enumerate(self.hashes):
            if len(h) and min(self.shingle, len(h)) == size:
                yield i, len(h), window_hashes(h, size)

    def all_shingles(self, size: int) -> np.ndarray:
        return np.unique(np.concatenate([s for _, _, s in self._of_size(size)]))

    def watch(self, size: int, shingles: np.ndarray) -> None:
        """Bits that let nearly all other shingles of a document pass by without a search."""
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[shingles & np.uint64((1 << _FILTER_BITS) - 1)] = True
        self.filters[size] = bits

    def found(self, size: int, shingles: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.filters[size][
            shingles & np.uint64((1 << _FILTER_BITS) - 1)])

    def choose_prefixes(self, counts: dict[int, int]) -> None:
        """Keep for every window only its rarest shingle; ties go to the smaller hash."""
        for size in self.sizes:
            known = self.all_shingles(size)
            n = np.array([counts.get(int(h), 0) for h in known.view(np.int64)], np.int64)
            rank = np.empty(len(known), np.int64)
            rank[np.lexsort((known, n))] = np.arange(len(known))
            rows = []
            for i, words, s in self._of_size(size):
                length = min(self.window, words)
                ranks = rank[np.searchsorted(known, s)]
                inside = np.lib.stride_tricks.sliding_window_view(ranks, length - size + 1)
                at = inside.argmin(axis=1)
                start = np.arange(len(at))
                rows.append((s[start + at], np.full(len(at), i), start, at))
            h, item, start, at = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(h, kind="stable")
            self.prefixes[size] = tuple(x[order] for x in (h, item, start, at))
            self.watch(size, np.unique(h))


def _groups(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    """Documents in groups of bounded size: rows, their words in a row, and where each begins."""
    for batch in stream:
        texts = texts_of(batch)
        done = 0
        words: list[bytes] = []
        begins = [0]
        for i, text in enumerate(texts):
            words += words_of(text)
            begins.append(len(words))
            if len(words) >= GROUP_WORDS or i == len(texts) - 1:
                yield batch.slice(done, i + 1 - done), words, np.array(begins)
                done, words, begins = i + 1, [], [0]


def _count_batches(index: Index):
    shingles = {size: index.all_shingles(size) for size in index.sizes}
    for size, s in shingles.items():
        index.watch(size, s)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        total = {size: np.zeros(len(s), np.int64) for size, s in shingles.items()}
        for _, words, begins in _groups(stream):
            h = known.array(words)
            for size, wanted in shingles.items():
                s = window_hashes(h, size)
                at = index.found(size, s)
                doc = np.searchsorted(begins, at, side="right") - 1
                inside = at + size <= begins[doc + 1]
                at, doc = at[inside], doc[inside]
                place = np.searchsorted(wanted, s[at]).clip(max=len(wanted) - 1)
                hit = wanted[place] == s[at]
                pairs = np.unique(doc[hit] * len(wanted) + place[hit])  # once per document
                total[size] += np.bincount(pairs % len(wanted), minlength=len(wanted))
        rows = ((int(x), int(n)) for size, s in shingles.items()
                for x, n in zip(s.view(np.int64), total[size]) if n)
        yield from batches(rows, _COUNTS, 20_000)
    return run


def _match_batches(index: Index):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for rows, words, begins in _groups(stream):
            before = rows.column("__before").to_pylist()
            h = known.array(words)
            hit = np.zeros(len(words), bool)
            items: list[set] = [set(b["items"]) if b else set() for b in before]
            for k, b in enumerate(before):
                if b:
                    n = int(begins[k + 1] - begins[k])
                    hit[begins[k]:begins[k + 1]] = np.unpackbits(
                        np.frombuffer(b["hits"], np.uint8), count=n).astype(bool)
            for size, (prefix, item, start, at) in index.prefixes.items():
                s = window_hashes(h, size)
                places = index.found(size, s)
                lo = np.searchsorted(prefix, s[places], side="left")
                hi = np.searchsorted(prefix, s[places], side="right")
                some = hi > lo
                for p, a, b in zip(places[some].tolist(), lo[some].tolist(), hi[some].tolist()):
                    k = int(np.searchsorted(begins, p, side="right")) - 1
                    for j in range(a, b):
                        i = int(item[j])
                        first = p - int(at[j])
                        length = min(index.window, len(index.words[i]))
                        if first < begins[k] or first + length > begins[k + 1]:
                            continue
                        w = int(start[j])
                        if words[first:first + length] == index.words[i][w:w + length]:
                            hit[first:first + length] = True
                            items[k].add(index.ids[i])
            marks = []
            for k in range(rows.num_rows):
                own = hit[begins[k]:begins[k + 1]]
                marks.append({"n_words": len(own), "n_hit": int(own.sum()),
                              "items": sorted(i for i in items[k] if i is not None),
                              "hits": np.packbits(own).tobytes()})
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(marks, _MARK)],
                                             names=[*rows.schema.names, COLUMN])
    return run


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs(text, ...)`` and ``contamination(n_words, n_hit, items, hits)``.

    A window is ``window`` consecutive words of an item of ``benchmark(item_id, text)``, or all words
    of a shorter item.  ``n_hit`` counts document words inside an occurrence of a window, ``hits``
    has them as bits, ``items`` has the ids of the items found, distinct, sorted as strings.

    Null and empty texts have no words, so such items have no window and such documents no hit.
    An item without id marks words but isn't listed; repeated items count once; an empty benchmark
    leaves zeros.  A column named ``contamination`` in the input is replaced; others stay.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text") \
        .where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    out = docs
    for block in range(blocks):
        rows = items.where(F.col("block") == block).collect()  # at most about block_bytes
        index = Index([(r.item_id, r.text.encode()) for r in rows], window, shingle)
        if index.sizes:
            counts = (docs.select("text").mapInArrow(_count_batches(index), "hash long, n long")
                      .groupBy("hash").agg(F.sum("n").alias("n")).collect())
            index.choose_prefixes({r.hash: r.n for r in counts})
        if block:
            out = staged(out, "contamination")
        out = add_column(out.withColumn("__before", F.col(COLUMN) if block else
                                        F.lit(None).cast(MARK_TYPE)),
                         COLUMN, MARK_TYPE, _match_batches(index)).drop("__before")
    return out


def contaminated(mark=COLUMN):
    """At least one word in twenty is hit."""
    return (F.col(f"{mark}.n_hit") > 0) & (F.col(f"{mark}.n_hit") * 20 >= F.col(f"{mark}.n_words"))
