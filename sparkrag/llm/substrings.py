"""Removal of word passages that an earlier document holds too, by counted window hashes.

A task hashes every window of its documents, keeps one entry per window sequence (the smallest
doc_id and the places in that document) and deals the entries by hash.  Packed as sorted
differences in byte planes an entry takes about ten bytes, so the shuffle of all windows costs little
more than that of the texts.  A window sequence therefore counts once per chunk of documents,
however many copies there are: no key grows with the copies.  The task of a hash range finds the
smallest doc_id of each sequence and sends back the windows of the others, which merge into
maximal intervals per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, WordHashes, batches, ids_of, parts_for, text_bytes, texts_of, \
    window_hashes

WINDOW = 13
CHUNK_WINDOWS = 2_000_000  # windows that a task sorts at once
TARGET = 16 << 20  # bytes of text per partition of the hash and document shuffles

_BLOB = pa.schema([("part", pa.int32()), ("body", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("starts", pa.list_(pa.int32())),
                    ("ends", pa.list_(pa.int32()))])


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together: differences are small, so the high planes vanish."""
    width = a.dtype.itemsize
    flat = np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(flat)


def _unplanes(body: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(dtype)


def pack(kind: int, hashes: np.ndarray | None, docs: np.ndarray, places: np.ndarray) -> bytes:
    """One blob: kind, and the columns as compressed byte planes; hashes must be sorted."""
    parts = [b"" if hashes is None else _planes(np.diff(hashes, prepend=np.uint64(0))),
             _planes(docs), _planes(places.astype(np.int32))]
    head = np.array([kind, *map(len, parts)], np.int64).tobytes()
    return head + b"".join(parts)


def unpack(blob: bytes) -> tuple[int, np.ndarray | None, np.ndarray, np.ndarray]:
    kind, a, b, _ = np.frombuffer(blob[:32], np.int64)
    body = blob[32:]
    hashes = np.cumsum(_unplanes(body[:a], np.uint64), dtype=np.uint64) if a else None
    return int(kind), hashes, _unplanes(body[a:a + b], np.int64), \
        _unplanes(body[a + b:], np.int32)


def _part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    mixed = docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _by_document(docs: np.ndarray, places: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Windows to remove, dealt by document."""
    part = _part_of(docs, parts)
    order = np.lexsort((places, docs, part))
    docs, places, part = docs[order], places[order], part[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    for d, p, k in zip(np.split(docs, cut), np.split(places, cut), np.split(part, cut)):
        if len(d):
            yield int(k[0]), pack(1, None, d, p)


def _chunk_rows(hashes, docs, places, parts: int) -> Iterator[tuple[int, bytes]]:
    """Entries of one chunk: its smallest document per sequence, and what that already decides."""
    order = np.lexsort((docs, hashes))
    h, d, p = hashes[order], docs[order], places[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    smallest = d[first][np.cumsum(first) - 1]
    later = d > smallest
    if later.any():
        yield from _by_document(d[later], p[later], parts)
    h, d, p = h[~later], d[~later], p[~later]
    edges = np.searchsorted(h, (np.arange(1, parts, dtype=np.uint64)
                                * np.uint64((1 << 64) // parts)))
    for k, (x, y) in enumerate(zip([0, *edges], [*edges, len(h)])):
        if y > x:
            yield k, pack(0, h[x:y], d[x:y], p[x:y])


def _window_batches(window: int, parts: int, chunk: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, held_n = WordHashes(), [], 0

        def flush():
            h, d, p = (np.concatenate(x) for x in zip(*held))
            yield from _chunk_rows(h, d, p, parts)

        def rows():
            nonlocal held, held_n
            for batch in stream:
                for doc, text in zip(ids_of(batch).tolist(), texts_of(batch)):
                    h = window_hashes(known.array((text or b"").split()), window)
                    if not len(h):
                        continue
                    held.append((h, np.full(len(h), doc, np.int64),
                                 np.arange(len(h), dtype=np.int32)))
                    held_n += len(h)
                    if held_n >= chunk:
                        yield from flush()
                        held, held_n = [], 0
            if held:
                yield from flush()

        yield from batches(rows(), _BLOB, 64)
    return run


def _decide(parts: int):
    """All entries of one hash range: windows whose sequence starts in a smaller document."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out, entries = [], []
        for body in table.column("body").to_pylist():
            kind, h, d, p = unpack(body)
            if kind:  # decided where it was found
                out += list(_by_document(d, p, parts))
            else:
                entries.append((h, d, p))
        if entries:
            h, d, p = (np.concatenate(x) for x in zip(*entries))
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            smallest = np.repeat(np.minimum.reduceat(d, start),
                                 np.diff(np.append(start, len(h))))
            later = d > smallest
            if later.any():
                out += list(_by_document(d[later], p[later], parts))
        return pa.Table.from_arrays([pa.array([k for k, _ in out], pa.int32()),
                                     pa.array([b for _, b in out], pa.binary())], schema=_BLOB)
    return run


def _intervals(window: int):
    """Windows of some documents merged into maximal runs of word numbers."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [unpack(b)[2:] for b in table.column("body").to_pylist()]
        d, p = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((p, d))
        d, p = d[order], p[order].astype(np.int64)
        opens = np.ones(len(d), bool)
        opens[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + window)
        start = np.flatnonzero(opens)
        last = np.append(start[1:], len(d)) - 1
        owner, lo, hi = d[start], p[start], p[last] + window
        cut = np.flatnonzero(np.diff(owner)) + 1
        ids = owner[np.concatenate([[0], cut])]
        offsets = pa.array(np.concatenate([[0], cut, [len(owner)]]), pa.int32())
        return pa.Table.from_arrays([
            pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(lo, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(hi, pa.int32()))], schema=_SPANS)
    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """``doc_id, starts, ends``: word intervals of ``docs(doc_id, text)`` to remove.

    Only documents with such an interval have a row.  Intervals are maximal, disjoint and in order.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    parts = parts_for(docs, text_bytes(docs), TARGET)
    blobs = "part int, body binary"
    entries = texts.mapInArrow(_window_batches(window, parts, chunk), blobs)
    decided = entries.groupBy("part").applyInArrow(_decide(parts), blobs)
    return decided.groupBy("part").applyInArrow(
        _intervals(window), "doc_id long, starts array<int>, ends array<int>")


def _cut_batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        n_words, n_removed, kept = [], [], []
        for text, starts, ends in zip(texts_of(batch), batch.column("starts").to_pylist(),
                                      batch.column("ends").to_pylist()):
            words = (text or b"").split()
            n = len(words)
            for a, b in zip(reversed(starts or []), reversed(ends or [])):
                del words[a:b]
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()),
             pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
             batch.column("starts"), batch.column("ends")],
            names=["doc_id", "n_words", "n_removed", "kept", "starts", "ends"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """Cut from every text the words of windows that a document with a smaller doc_id holds too.

    Input ``docs(doc_id, text)``, other columns are ignored.  Words are runs without ASCII white
    space; a window is ``window`` consecutive words.  Windows are judged on the input.  Returns
    ``doc_id, n_words, n_removed, kept, starts, ends`` per row: ``kept`` joins what is left by one
    space, ``starts``/``ends`` are the removed word intervals (null: none).

    Null and empty texts have no words.  Null doc_ids sort before all others and lose nothing.
    doc_id names a document: rows that repeat one with the same text get the same result, and
    rows that share one never cut each other; if their texts differ, the intervals of both hold for both.
    Sequences are told apart by 64-bit hashes: with n windows, about n**2 / 2**65 pairs of
    different sequences are taken as equal (one in 2000 runs over 140 million windows).
    """
    spans = repeated_spans(docs, window, chunk)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.join(spans.where(F.col("doc_id") != NO_ID), "doc_id", "left").mapInArrow(
        _cut_batches, "doc_id long, n_words long, n_removed long, kept string, "
                      "starts array<int>, ends array<int>")
