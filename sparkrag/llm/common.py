"""Helpers of the operators: word hashes inside tasks, Arrow batches, sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_WORDS = 500_000
NO_ID = -(2 ** 63)  # stands for a null id inside tasks; sorts before all others


class WordHashes(dict):
    """64-bit hashes of byte words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return batch.column(name).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all runs of ``size`` word hashes.

    The polynomial of a run is put together from runs of 1, 2, 4, ... words, so a window costs
    a few vector operations instead of one step per word.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, power, width = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x9E3779B97F4A7C15), 1
    out, done, part = None, 0, h
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                if out is None:
                    out = part[:n].copy()
                else:
                    out *= power
                    out += part[done:done + n]
                done += width
            if done == size:
                break
            part = part[:len(part) - width] * power + part[width:]
            power *= power
            width *= 2
        out ^= out >> np.uint64(29)
        out *= base
        out ^= out >> np.uint64(32)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def add_column(df: DataFrame, name: str, kind: T.DataType, fn) -> DataFrame:
    """``df`` with a column that ``fn`` puts behind those of its Arrow batches.

    The column replaces one of that name; names that Arrow functions can't take are set aside.
    """
    df = df.select(*quoted([c for c in df.columns if c != name]))
    plain = [f"__{i}" if set(c) & set(".`") else c for i, c in enumerate(df.columns)]
    out = df.toDF(*plain)
    schema = T.StructType([*out.schema.fields, T.StructField(name, kind)])
    return out.mapInArrow(fn, schema).toDF(*df.columns, name)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, to size partitions and blocks by."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def parts_for(df: DataFrame, size: int, target: int) -> int:
    """Partitions of about ``target`` bytes, and no fewer than the session's shuffle has."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // target))


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows that a task yields one at a time."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
