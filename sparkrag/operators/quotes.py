"""Documents that quote items: shared windows of words, by an equi-join on their hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import once

WINDOW = 13
# Item windows up to this many bytes go to every task; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
PIECE = 1 << 18  # words whose windows are made at once
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def quote_words(text) -> Column:
    """Runs of letters and digits, lower-cased."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashed(df: DataFrame, key: str) -> DataFrame:
    """``key, x, y``: the words of ``text`` as two hashes each."""
    words = once(df.select(key, "text"), "w", quote_words("text")).where(F.size("w") > 0)
    return words.select(key, F.transform("w", lambda w: F.xxhash64(w)).alias("x"),
                        F.transform("w", lambda w: F.xxhash64(F.lit(1), w)).alias("y"))


def _window_hashes(words: np.ndarray, n: int, by: int) -> np.ndarray:
    """A number for each ``n`` neighbours in ``words``: their polynomial, modulo 2 ** 64."""
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out *= np.uint64(by)
        out += words[k:k + len(out)]
    return out


def _windows(df: DataFrame, key: str, sizes: list[int], longest: int | None = None) -> DataFrame:
    """``key, n, a, b``: the windows of ``sizes`` of all rows ``(key, x, y)``, or, with ``longest``, of
    each row only those of ``longest`` words or of the whole row if it is shorter."""
    out = T.StructType([df.schema[key], T.StructField("n", T.IntegerType()),
                        T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def windows(batches):
        for batch in batches:
            keys, x, y = batch.column(0), batch.column(1), batch.column(2)
            ends = x.offsets.to_numpy()
            xs, ys = (c.values.to_numpy().view(np.uint64) for c in (x, y))
            lo = 0
            while lo < len(keys):  # rows of about PIECE words at a time
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, "right")) - 1)
                at = ends[lo:hi + 1] - ends[lo]
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                left = at[1:][row] - np.arange(len(row))  # words from here to the row's end
                for n in sizes:
                    if len(row) < n:
                        continue
                    keep = left[:len(row) - n + 1] >= n
                    if longest is not None and n < longest:
                        keep &= np.diff(at)[row[:len(keep)]] == n
                    part = slice(ends[lo], ends[hi])
                    a, b = (_window_hashes(v[part], n, by)[keep].view(np.int64)
                            for v, by in ((xs, _BASES[0]), (ys, _BASES[1])))
                    ids = keys.take(pa.array(row[:len(keep)][keep] + lo))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.full(len(a), n, np.int32)), pa.array(a), pa.array(b)],
                        [key, "n", "a", "b"])
                lo = hi
    return df.mapInArrow(windows, out)


def quoted_pairs(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``query_id, chunk_id, windows``: documents ``(chunk_id, text)`` that hold a window of an item
    ``(query_id, text)``, and how many different ones.

    A window is ``window`` consecutive words, or all words of a shorter item.  The whole of both texts
    counts.  Windows are compared by 128 bits of hashes.
    """
    asked = _windows(_hashed(items, "query_id"), "query_id", list(range(1, window + 1)), window).distinct()
    # At most ``window`` different sizes.
    row = asked.agg(F.sort_array(F.collect_set("n")).alias("sizes"), F.count("*").alias("n")).first()
    if row["n"] * 40 <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    held = _windows(_hashed(docs, "chunk_id"), "chunk_id", row["sizes"])
    return held.join(asked, ["n", "a", "b"]).groupBy("query_id", "chunk_id").agg(
        F.count_distinct("n", "a", "b").alias("windows"))
