"""SimHash near-duplicates through an inverted index of positional fingerprint bytes.

Two fingerprints that differ in at most ``d`` bits (here 3) agree in at least ``8 - d`` of their eight
positional bytes.  Posting lists of single bytes would hold 1/256 of all fingerprints each, so the
index joins three positions into one posting: five equal bytes of eight put three of them into one
half of the fingerprint, and a half has four such triples.  Eight postings per fingerprint find
every pair; within a posting the shared positional bytes of a pair are tallied, pairs below the
guaranteed minimum go, the rest are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from .common import quoted, texts_of
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
BLOCK = 30_000  # fingerprints of one posting that a task compares at once
SHORT_RUN = 16  # postings up to this length are compared pair by pair, in vectors


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of one text: bit j is set in more than half of the shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(
        (digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(SHINGLE)))),
        np.uint64, n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # bounded memory for texts of any length
        part = hashes[i:i + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64)
        total += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        marks = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(marks.view(np.int64))],
            names=["doc_id", "row", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, row, mark``: a hash of the text, and its fingerprint, as signed longs.

    Null counts as empty.
    """
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text") \
        .mapInArrow(_fingerprint_batches, "doc_id long, row long, mark long")


def _postings(mark: Column) -> Column:
    """The eight postings: position triple and its three bytes in one long."""
    slots = []
    for half in (0, 4):
        for left_out in range(4):
            bytes_ = [F.shiftrightunsigned(mark, 8 * (half + i)).bitwiseAND(F.lit(255))
                      for i in range(4) if i != left_out]
            slots.append(F.lit((half + left_out) << 24) + bytes_[0] * 65536 + bytes_[1] * 256
                         + bytes_[2])
    return F.array(*slots)


def linked(x: np.ndarray) -> np.ndarray:
    """Which differences of two fingerprints are links: byte tally first, then the bits."""
    shared = np.zeros(len(x), np.uint8)
    for i in range(8):
        shared += (x >> np.uint64(8 * i)) & np.uint64(255) == 0
    out = shared >= MIN_BYTES
    out[out] = np.bitwise_count(x[out]) <= MAX_BITS
    return out


def _forest(marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the fingerprints of one posting, without all pairs of a dense group.

    A fingerprint is compared only with those not reached yet, so a group of near copies costs
    one pass per copy that reaches new ones.
    """
    out, rest = [], np.unique(marks)
    while len(rest) > 1:
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            pivot = open_.pop()
            near = linked(rest ^ pivot)
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), pivot), found))
                open_.extend(found)
                rest = rest[~near]
    return out


def _runs(keys: list[np.ndarray], marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside each run of equal keys."""
    n = len(marks)
    if n < 2:
        return []
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, n))
    run = np.repeat(np.arange(len(start)), size)
    short = np.repeat(size <= SHORT_RUN, size)
    out = []
    for shift in range(1, min(SHORT_RUN, int(size.max()))):
        pair = np.flatnonzero((run[shift:] == run[:-shift]) & short[shift:])
        a, b = marks[pair], marks[pair + shift]
        keep = linked(a ^ b)
        out.append((a[keep], b[keep]))
    for i in np.flatnonzero(size > SHORT_RUN):
        out += _forest(marks[start[i]:start[i] + size[i]])
    return out


def _link_batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings in, links out; a run may go over the border of two batches."""
    names = ("slot", "block_a", "block_b")
    held: list[pa.RecordBatch] = []

    def done(cols: dict[str, np.ndarray], upto: int) -> Iterator[pa.RecordBatch]:
        found = _runs([cols[k][:upto] for k in names], cols["mark"][:upto].view(np.uint64))
        if found:
            a = np.concatenate([x for x, _ in found]).view(np.int64)
            b = np.concatenate([x for _, x in found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)),
                                              pa.array(np.maximum(a, b))], names=["a", "b"])

    rest: dict[str, np.ndarray] | None = None
    for batch in stream:
        cols = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*names, "mark")}
        if rest is not None:
            cols = {k: np.concatenate([rest[k], v]) for k, v in cols.items()}
        if not len(cols["mark"]):
            continue
        same = np.ones(len(cols["mark"]), bool)
        for k in names:
            same &= cols[k] == cols[k][-1]
        upto = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if upto:
            yield from done(cols, upto)
        rest = {k: v[upto:] for k, v in cols.items()}
    if rest is not None:
        yield from done(rest, len(rest["mark"]))


def links(marks: DataFrame) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints of ``marks(mark)``.

    Every pair within reach is connected by the links, though not every pair is a row.  Postings
    longer than ``BLOCK`` are cut into blocks and compared block against block, so no task holds
    an unbounded posting.
    """
    index = marks.select("mark", F.explode(_postings(F.col("mark"))).alias("slot"))
    hot = (index.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
           .select("slot", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    index = index.join(hot, "slot", "left")
    block = F.pmod(F.xxhash64("mark"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = (index.select("slot", "mark", block.alias("own"), other.alias("other"))
             .select("slot", "mark", F.least("own", "other").alias("block_a"),
                     F.greatest("own", "other").alias("block_b")))
    keys = ["slot", "block_a", "block_b"]
    return (dealt.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(_link_batches, "a long, b long").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, row, mark, root, component_id`` for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links of at most three differing bits reach, the own
    one included.  Equal fingerprints are one class before any comparison, so exact copies cost
    nothing; links are found between classes.  Null and empty texts have fingerprint zero and are
    linked like any other; a null doc_id is never the smallest, and a component without any
    doc_id has a null component_id, while ``root`` tells all components apart.  ``row`` is the hash
    of the text.  Repeated rows get equal results; other columns are ignored.
    """
    marked = staged(fingerprints(docs), "marks")
    classes = staged(marked.groupBy("mark").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("mark")))
    rooted = (classes.join(roots.withColumnRenamed("node", "mark"), "mark", "left")
              .select("mark", "least", F.coalesce("root", "mark").alias("root")))
    rooted = staged(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return (marked.join(rooted.select("mark", "root").join(smallest, "root"), "mark")
            .select("doc_id", "row", "mark", "root", "component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with one row of each component.

    That is the row with the smallest doc_id (rows without id come last), then the smallest hash
    of the text; of rows that repeat both one stays.
    """
    found = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = found.groupBy("root").agg(first.alias("k")).select("k.doc_id", "k.row").alias("k")
    keyed = docs.withColumn("__row", F.xxhash64("text")).alias("d")
    joined = keyed.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
                        & (F.col("d.__row") == F.col("k.row"))).select("d.*")
    order = Window.partitionBy("doc_id", "__row").orderBy(F.lit(0))
    return (joined.withColumn("__n", F.row_number().over(order)).where("__n = 1")
            .select(*quoted(docs.columns)))


def mark_text(mark: Column) -> Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))
