"""Ranked lexical search of many queries at once, sharing what their terms have in common.

Term sets that several items hold are mined from all items: terms get one common order, and pairs of
neighbours that at least two items have become nodes, over and over, until no such pair is left.  The
nodes form a graph in which every item is the sum of a few of them.  For the documents of a task
each node is a row of partial scores, added once from the two it is made of; an item adds its
nodes.  All scores are integers, so the order of additions changes nothing.

The documents are tokenized once: what is kept of them is their length and the counts of terms that some
item holds, and document frequencies and scores are both taken from that table.  A task sends on
its best ``k`` documents per item.  Items travel in blocks of bounded size: more items take more
passes over the documents, never a larger message to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import top_n
from ..sources.stage import staged
from .common import NO_ID, batches, ids_of, texts_of
from .decontaminate import words_of

K = 20
BLOCK_BYTES = 4 << 20  # text of the items that one pass over the documents carries
HELD = 4 << 20  # partial scores that a task holds at once
GROUP = 1024  # documents scored together at most

_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()),
                       ("counts", pa.binary())])
_DF = pa.schema([("term", pa.int32()), ("n", pa.int64())])
_HITS = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Sharing:
    """Nodes over ``terms`` numbered terms: node ``terms + i`` is ``left[i] + right[i]``.

    Nodes of one level only need earlier levels; ``levels`` has where each ends.  ``items`` has the
    terms and nodes that an item is the sum of.
    """

    terms: int
    items: list[list[int]]
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)


def _replace(row: list[int], made: dict[tuple[int, int], int]) -> list[int]:
    out, i = [], 0
    while i < len(row):
        node = made.get((row[i], row[i + 1])) if i + 1 < len(row) else None
        out.append(row[i] if node is None else node)
        i += 1 if node is None else 2
    return out


def share(items: list[list[int]], terms: int) -> Sharing:
    """The graph for items given as term numbers, repeats included.

    Each round turns the most frequent pairs of neighbours into nodes, no term or node in two pairs of a
    round; a pair counts once per item.  A round costs one walk over the items.
    """
    spread = Counter(t for row in items for t in set(row))
    rows = [sorted(row, key=lambda t: (-spread[t], t)) for row in items]
    graph = Sharing(terms, rows)
    while True:
        pairs = Counter(p for row in graph.items for p in set(zip(row, row[1:])))
        busy: set[int] = set()
        made: dict[tuple[int, int], int] = {}
        for pair, times in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            if times < 2:
                break
            if busy.isdisjoint(pair):
                busy.update(pair)
                made[pair] = terms + len(graph.left)
                graph.left.append(pair[0])
                graph.right.append(pair[1])
        if not made:
            return graph
        graph.levels.append(len(graph.left))
        graph.items = [_replace(row, made) for row in graph.items]


def _posting_batches(numbers: dict[bytes, int]):
    """Length of every document with terms, and the counts of those that some item holds."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = numbers.get

        def rows():
            for batch in stream:
                for doc, text in zip(ids_of(batch).tolist(), texts_of(batch)):
                    words = words_of(text)
                    if words:
                        known = [t for t in map(find, words) if t is not None]
                        t, c = np.unique(np.array(known, np.int32), return_counts=True)
                        yield doc, len(words), t.tobytes(), c.astype(np.int32).tobytes()
        yield from batches(rows(), _POSTINGS, 1000)
    return run


def _df_batches(terms: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in stream:
            held = b"".join(batch.column("terms").to_pylist())
            total += np.bincount(np.frombuffer(held, np.int32), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=_DF)
    return run


@dataclass
class _Best:
    """The ``k`` best documents of each item that a task has seen."""

    k: int
    scores: list[np.ndarray]
    docs: list[np.ndarray]

    def add(self, first: int, got: np.ndarray, docs: np.ndarray) -> None:
        """Scores of items from number ``first`` on, one row each, for ``docs``."""
        for i, row in enumerate(got, first):
            full = len(self.scores[i]) == self.k
            at = np.flatnonzero(row >= (self.scores[i][-1] if full else 1))
            if len(at):
                s = np.concatenate([self.scores[i], row[at]])
                d = np.concatenate([self.docs[i], docs[at]])
                order = np.lexsort((d, -s))[:self.k]
                self.scores[i], self.docs[i] = s[order], d[order]


def _score_batches(graph: Sharing, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    left, right = (np.array(x, np.int64) for x in (graph.left, graph.right))
    flat = np.array([s for row in graph.items for s in row], np.int64)
    begins = np.cumsum([0, *map(len, graph.items)])
    size = graph.terms + len(left)
    group = int(max(1, min(GROUP, HELD // size)))  # documents at once
    # Items in runs whose gathered rows stay within the same bound.
    cuts = [0]
    for i in range(1, len(graph.items) + 1):
        if (begins[i] - begins[cuts[-1]]) * group > HELD and i - 1 > cuts[-1]:
            cuts.append(i - 1)
    cuts.append(len(graph.items))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = _Best(k, [none] * len(graph.items), [none] * len(graph.items))
        for batch in stream:
            docs = ids_of(batch)
            lengths = batch.column("n").to_pylist()
            terms, counts = (batch.column(c).to_pylist() for c in ("terms", "counts"))
            for a in range(0, batch.num_rows, group):
                b = min(a + group, batch.num_rows)
                t = np.frombuffer(b"".join(terms[a:b]), np.int32)
                tf = np.frombuffer(b"".join(counts[a:b]), np.int32).astype(np.int64)
                at = np.repeat(np.arange(b - a), [len(x) // 4 for x in terms[a:b]])
                m = np.array([75 + 25 * n * n_docs // n_terms for n in lengths[a:b]], np.int64)
                held = np.zeros((size, b - a), np.int64)
                held[t, at] = weights[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m[at]))
                done = 0
                for end in graph.levels:  # every shared sum once per document
                    held[graph.terms + done:graph.terms + end] = (
                        held[left[done:end]] + held[right[done:end]])
                    done = end
                for x, y in zip(cuts, cuts[1:]):
                    rows = held[flat[begins[x]:begins[y]]]
                    best.add(x, np.add.reduceat(rows, begins[x:y] - begins[x], axis=0),
                             docs[a:b])
        found = ((i, d, s) for i in range(len(graph.items))
                 for d, s in zip(best.docs[i].tolist(), best.scores[i].tolist()))
        yield from batches(found, _HITS, 10_000)
    return run


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """Items with terms, in blocks of at most ``size`` bytes of text or one item."""
    held, total = [], 0
    for r in items.toLocalIterator():  # one partition of the items at a time
        words = words_of((r["text"] or "").encode())
        if not words:
            continue
        if held and total + len(r["text"]) > size:
            yield held
            held, total = [], 0
        held.append((r["item_id"], words))
        total += len(r["text"])
    if held:
        yield held


def _search_block(docs: DataFrame, block: list[tuple], kind: T.DataType, k: int) -> DataFrame:
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    rows = [[numbers.setdefault(w, len(numbers)) for w in words] for _, words in block]
    postings = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _posting_batches(numbers), "doc_id long, n long, terms binary, counts binary"), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
    df = {r.term: r.n for r in postings.select("terms").mapInArrow(
        _df_batches(len(numbers)), "term int, n long")
        .groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most the terms of the block
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(numbers))], np.int64)
    hits = postings.mapInArrow(
        _score_batches(share(rows, len(numbers)), weights, n_docs, n_terms or 1, k),
        "item int, doc_id long, score long")
    hits = hits.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
    ranked = top_n(hits, ["item"], [F.desc("score"), F.asc_nulls_first("doc_id")], k)
    ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)],
                                T.StructType([T.StructField("item", T.IntegerType()),
                                              T.StructField("item_id", kind)]))
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES
           ) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs(doc_id, text)`` for each item.

    A score sums, over the terms of an item of ``items(item_id, text)`` with repeats, the term's
    weight times ``10**9 * tf div (1000 * tf + 12 * m)``, where ``m`` is 75 plus 25 times the
    document's length over the mean length, rounded down.  Only scores above 0 are listed; equal
    scores go by ascending doc_id, a null doc_id first.

    Null, empty and word-free texts have no terms: such documents don't count and are never found, such
    items have no rows.  Every row is a document of its own, also where a doc_id repeats, and every
    row of ``items`` an item of its own, ranked apart.  Empty tables give an empty result.  Other columns
    of both tables are not read.
    """
    kind = items.schema["item_id"].dataType
    out = None
    for block in _blocks(items.select("item_id", "text"), block_bytes):
        found = _search_block(docs, block, kind, k)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], T.StructType([
            T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    return out


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = f"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'),
    '{_TERM}')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT
    AS w FROM p, g GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'),
      '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf)
    // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}"""
