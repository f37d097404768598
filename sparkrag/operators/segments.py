"""Splitting of runs of text that no task has to hold whole.

The texts of a document lie one behind the other on one scale of characters, from running sums.  The
scale is cut into segments of bounded length, each with what a window that begins in it can reach.
Where the first window of a segment begins depends on all windows before it, but only through that one
number: a segment that a run crosses says, for every place where a window could begin, where the
first window of the next segment begins and how many pieces it keeps.  These short tables
are chained per document; then all segments are split on their own.  A document within one
segment needs none of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.splitting import window_end
from ..functions.text import strip
from ..sources.stage import staged

SEGMENT = 1 << 18  # characters of a segment

_PIECES = pa.list_(pa.struct([
    ("source_index", pa.int64()), ("section", pa.string()), ("piece", pa.int32()),
    ("text", pa.string()), ("tail", pa.bool_()), ("edge", pa.bool_())]))
_PIECES_DDL = ("array<struct<source_index:bigint,section:string,piece:int,text:string,tail:boolean,"
               "edge:boolean>>")
_SUMMARY_DDL = ("struct<starts:array<int>,exits:array<int>,counts:array<int>,fresh:boolean,exit:int,"
                "count:int,source:bigint>")
_ENTRY = pa.schema([("seg", pa.int64()), ("entry", pa.int32()), ("source", pa.int64()),
                    ("count", pa.int32()), ("more", pa.bool_())])


@dataclass
class Rule:
    """Window size and overlap, the length under which a last piece joins the one before, and the
    length of a segment."""

    size: int
    overlap: int
    min_tail: int
    segment: int


@dataclass
class _Run:
    """The visible part of a run: its place on the scale, whether it begins there, and its text."""

    at: int
    first: bool
    source: int
    section: str
    text: str


def _runs(items: list[dict]) -> list[_Run]:
    runs: list[_Run] = []
    texts: list[list[str]] = []
    last = None
    for x in items:
        if x["run"] != last:
            runs.append(_Run(x["at"], x["first"], x["pos"], x["section"], ""))
            texts.append([])
            last = x["run"]
        texts[-1].append(x["text"])
    for run, parts in zip(runs, texts):
        run.text = "".join(parts).removesuffix("\n")
    return runs


def _windows(run: _Run, lo: int, stop: int, rule: Rule) -> Iterator[tuple[str, int]]:
    """Kept texts (empty: none) of the windows that begin before ``stop``, each with the place of the next
    window, -1 at the end of the run."""
    while 0 <= lo < stop:
        at = lo - run.at
        hi = window_end(run.text, at, rule.size)
        piece = run.text[at:hi if hi >= 0 else None].strip()
        lo = -1 if hi < 0 else run.at + max(hi - rule.overlap, at + 1)
        yield piece if len(piece) >= V.MIN_CHUNK_CHARS else "", lo


def _split_segment(items: list[dict], seg: int, rule: Rule, entry: int = -1, source: int = 0,
                   count: int = 0, more: bool = False) -> list[dict]:
    """All pieces whose windows begin in the segment; ``entry`` is where the run that comes in goes on,
    ``more`` says that the run that goes out keeps further pieces."""
    base, stop, out = seg * rule.segment, (seg + 1) * rule.segment, []
    for run in _runs(items):
        if run.at >= stop:
            continue
        lo, n, src = (run.at, 0, run.source) if run.first else (base + entry, count, source)
        if not run.first and entry < 0:
            continue
        kept, end = [], lo
        for piece, end in _windows(run, lo, stop, rule):
            if piece:
                kept.append(piece)
        last = end < 0 or not more
        short = last and kept and n + len(kept) > 1 and len(kept[-1]) < rule.min_tail
        alone = len(kept) == 1
        if short and not alone:
            kept[-2:] = [(kept[-2] + kept[-1]).strip()]
        for i, piece in enumerate(kept):
            at_end = i == len(kept) - 1
            out.append({"source_index": src, "section": run.section, "piece": n + i, "text": piece,
                        "tail": bool(short and alone),
                        "edge": at_end and not last})
    return out


def _summary(items: list[dict], seg: int, rule: Rule) -> dict:
    """What the segment makes of every entry of the run that comes in, and of the last run begun in it."""
    base, stop = seg * rule.segment, (seg + 1) * rule.segment
    out = {"starts": [], "exits": [], "counts": [], "fresh": False, "exit": -1, "count": 0,
           "source": None}
    for run in _runs(items):
        if run.at >= stop:
            continue
        if run.first:
            end, n = run.at, 0
            for piece, end in _windows(run, run.at, stop, rule):
                n += bool(piece)
            out |= {"fresh": True, "source": run.source, "count": n,
                    "exit": end - stop if end >= 0 else -1}
            continue
        known: dict[int, tuple[int, int]] = {}
        for entry in range(base, min(base + rule.size + 1, run.at + len(run.text))):
            path, lo = [], entry
            while 0 <= lo < stop and lo not in known:
                piece, after = next(_windows(run, lo, stop, rule))
                path.append((lo, bool(piece)))
                lo = after
            exit_, n = known.get(lo, (lo - stop if lo >= 0 else -1, 0))
            for at, keeps in reversed(path):
                n += keeps
                known[at] = exit_, n
            exit_, n = known[entry]
            if not out["starts"] or (out["exits"][-1], out["counts"][-1]) != (exit_, n):
                out["starts"].append(entry - base)
                out["exits"].append(exit_)
                out["counts"].append(n)
    return out


def _chain(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Entries of the segments of one document, from their summaries."""
    rows = sorted(zip(table.column("seg").to_pylist(), table.column("s").to_pylist()),
                  key=lambda r: r[0])
    entry, source, count, out, open_rows = -1, 0, 0, [], []
    for seg, s in rows:
        mine = {"seg": seg, "entry": entry, "source": source, "count": count, "more": False}
        out.append(mine)
        before = count
        if entry >= 0:
            k = max(i for i, e in enumerate(s["starts"]) if e <= entry)
            entry, count = s["exits"][k], count + s["counts"][k]
            if count > before:  # the segments before it see further pieces
                for r in open_rows:
                    r["more"] = True
                open_rows = []
        if s["fresh"]:
            entry, source, count, open_rows = s["exit"], s["source"], s["count"], []
        if entry >= 0:
            open_rows.append(mine)
    return pa.Table.from_pylist(out, _ENTRY).add_column(
        0, "doc_id", pa.array([key[0].as_py()] * len(out), key[0].type))


def _segments(texts: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, seg, items``: slices of ``texts(doc_id, pos, run, section, first, at, body)``."""
    n, ahead = rule.segment, rule.size + 2
    line = F.concat("body", F.lit("\n"))
    end = F.col("at") + F.length("body") + 1
    from_ = F.greatest(F.floor((F.col("at") - ahead) / n), F.lit(0))
    cut = texts.withColumn("seg", F.explode(F.sequence(from_, F.floor((end - 1) / n))))
    lo = F.greatest(F.col("at"), F.col("seg") * n)
    hi = F.least(end, (F.col("seg") + 1) * n + ahead)
    item = F.struct(
        lo.alias("at"), "run", (F.col("first") & (lo == F.col("at"))).alias("first"), "pos", "section",
        F.substring(line, (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")).alias("text"))
    return cut.groupBy("doc_id", "seg").agg(F.array_sort(F.collect_list(item)).alias("items"))


def split_runs(texts: DataFrame, size: int, overlap: int, min_tail: int,
               segment: int | None = None) -> DataFrame:
    """``doc_id, source_index, section, piece, text``: the runs of ``texts`` joined by line feeds and
    split as ``functions.splitting.chunk_text`` does, whatever their length.

    ``texts``: doc_id, pos, run, section, first (the first text of its run), at (its place among the
    characters of the document, one more than its length apart from the next), body (stripped,
    not empty).
    """
    rule = Rule(size, overlap, min_tail, segment or SEGMENT)
    parts = staged(_segments(texts, rule), "segments")
    reach = F.exists("items", lambda x: x["at"] + F.length(x["text"])
                     > (F.col("seg") + 1) * rule.segment)
    crossed = (F.col("seg") > 0) | reach

    @F.arrow_udf(_PIECES_DDL)
    def alone(items: pa.Array, seg: pa.Array) -> pa.Array:
        return pa.array([_split_segment(i, k, rule) for i, k in
                         zip(items.to_pylist(), seg.to_pylist())], _PIECES)

    @F.arrow_udf(_SUMMARY_DDL)
    def summary(items: pa.Array, seg: pa.Array) -> pa.Array:
        return pa.array([_summary(i, k, rule) for i, k in zip(items.to_pylist(), seg.to_pylist())],
                        pa.struct([("starts", pa.list_(pa.int32())), ("exits", pa.list_(pa.int32())),
                                   ("counts", pa.list_(pa.int32())), ("fresh", pa.bool_()),
                                   ("exit", pa.int32()), ("count", pa.int32()),
                                   ("source", pa.int64())]))

    @F.arrow_udf(_PIECES_DDL)
    def entered(items: pa.Array, seg: pa.Array, entry: pa.Array, source: pa.Array, count: pa.Array,
                more: pa.Array) -> pa.Array:
        return pa.array([_split_segment(i, k, rule, *rest) for i, k, *rest in zip(
            *(x.to_pylist() for x in (items, seg, entry, source, count, more)))], _PIECES)

    names = ["doc_id", "source_index", "section", "piece", "text"]
    short = parts.where(~crossed).select("doc_id", F.inline(alone("items", "seg"))).select(*names)
    long = parts.where(crossed)
    doc = texts.schema["doc_id"].dataType.simpleString()
    chained = staged(long.select("doc_id", "seg", summary("items", "seg").alias("s"))
                     .groupBy("doc_id").applyInArrow(
        _chain, f"doc_id {doc}, seg long, entry int, source long, count int, more boolean"), "chain")
    pieces = staged(long.join(chained, ["doc_id", "seg"]).select("doc_id", F.inline(entered(
        "items", "seg", "entry", "source", "count", "more"))), "pieces")
    # A short last piece alone in its segment joins the last one that an earlier segment kept.
    tails = pieces.where("tail").select("doc_id", "source_index", (F.col("piece") - 1).alias("piece"),
                                        F.col("text").alias("more"))
    edges = pieces.where("edge").join(tails, ["doc_id", "source_index", "piece"], "left").withColumn(
        "text", F.when(F.col("more").isNull(), F.col("text")).otherwise(
            strip(F.concat("text", "more"))))
    return short.unionByName(pieces.where("NOT tail AND NOT edge").select(*names)).unionByName(
        edges.select(*names))

