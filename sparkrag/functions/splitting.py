"""Sentence-aware splitting.  Sequential by nature, so a pandas UDF; short texts stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from .text import lengths, row_spans, strip

_STRONG, _WEAK = "。.；;\n", "，, "


def _last_of(text: str, marks: str, lo: int, hi: int) -> int:
    """Offset from ``lo`` of the last mark in ``text[lo:hi]``, negative when there is none."""
    at = max(text.rfind(m, lo, hi) for m in marks)
    return at - lo if at >= 0 else -1


def window_end(text: str, lo: int, size: int) -> int:
    """End of the window from ``lo``: at a sentence mark where one is near, -1 for the last window."""
    hi = lo + size
    if hi >= len(text):
        return -1
    cut = _last_of(text, _STRONG, lo, hi)
    if cut < size * 0.5:
        cut = _last_of(text, _WEAK, lo, hi)
    return lo + cut + 1 if cut > size * 0.4 else hi


def split_spans(text: str, size: int, overlap: int) -> list[str]:
    """Windows of at most ``size`` characters that end at a sentence mark where one is near."""
    spans, lo = [], 0
    while True:
        hi = window_end(text, lo, size)
        if hi < 0:
            spans.append(text[lo:])
            return spans
        spans.append(text[lo:hi])
        lo = max(hi - overlap, lo + 1)


def _pieces(text: str, size: int, overlap: int, min_tail: int) -> list[str]:
    kept = [p for p in (s.strip() for s in split_spans(text, size, overlap))
            if len(p) >= V.MIN_CHUNK_CHARS]
    if min_tail and len(kept) > 1 and len(kept[-1]) < min_tail:
        kept[-2:] = [(kept[-2] + kept[-1]).strip()]
    return kept


def _whole_or_pieces(text: str, size: int, overlap: int, min_tail: int) -> list[str]:
    text = text.strip()
    if len(text) <= size:
        return [text] if len(text) >= V.MIN_CHUNK_CHARS else []
    return _pieces(text, size, overlap, min_tail)


def chunks_of(text: str | None, size: int = V.SECTION_CHUNK_SIZE,
              ratio: float = V.SECTION_OVERLAP_RATIO) -> list[str]:
    """Section chunks of one text, for the SQL table functions."""
    return _whole_or_pieces(text or "", size, max(1, int(size * ratio)), V.SECTION_MIN_TAIL)


def _split(col: Column, size: Column, overlap: Column, min_tail: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def long_pieces(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]
                    ) -> Iterator[pd.Series]:
        for t, n, o in batches:
            if not len(t):
                yield pd.Series([], dtype=object)
            for lo, hi in row_spans(lengths(t)):
                rows = zip(t.iloc[lo:hi], n.iloc[lo:hi], o.iloc[lo:hi])
                yield pd.Series([_whole_or_pieces(x, int(a), int(b), min_tail)
                                 if x is not None else None for x, a, b in rows], dtype=object)

    # Only texts that may need a cut go to Python.
    short = F.filter(F.array(strip(col)), lambda x: F.length(x) >= V.MIN_CHUNK_CHARS)
    long = F.length(col) > size
    return F.when(long, long_pieces(F.when(long, col), size, overlap)).otherwise(short)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def split_text(col, size=V.CORPUS_CHUNK_SIZE, overlap=V.CORPUS_CHUNK_OVERLAP) -> Column:
    """Pieces of a text as ``array<string>``; pieces under 60 characters are dropped."""
    c = F.col(col) if isinstance(col, str) else col
    return _split(c, _lit(size), _lit(overlap), 0)


def chunk_text(col, size: int = V.SECTION_CHUNK_SIZE,
               ratio: float = V.SECTION_OVERLAP_RATIO) -> Column:
    """As ``split_text`` with a proportional overlap; a tail under 150 joins the piece before."""
    c = F.col(col) if isinstance(col, str) else col
    return _split(c, F.lit(size), F.lit(max(1, int(size * ratio))), V.SECTION_MIN_TAIL)
