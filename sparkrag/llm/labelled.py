"""Labelled rows for the classifiers: the fixed held-out fold and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT = 2


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows whose crc32 of the doc_id as text leaves 2 modulo ``folds``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
                      == HELD_OUT, F.lit(False))


def sample_ids(ids: DataFrame, size: int, seed: int) -> DataFrame:
    """At most ``size`` rows of ``ids(doc_id, ...)``, by the smallest hashes of the id."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(size)


def with_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of a bounded sample; the sample is small enough to send to every task."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
