"""Token ids in grammar-compressed files with random access.

Documents are dealt to shards by ranges of doc_id and written in ascending order.  Within a block of
a shard, frequent pairs of neighbouring ids become nonterminals, round after round (Re-Pair); no
pair crosses a document.  A block stores its rules, the expansion length of every nonterminal, the
symbols, and for each document where its symbols begin and how many ids they stand for, so one
document, or a range of ids inside it, is expanded without the rest.

The container is Parquet with a row per block, written by Spark's own committer: any store that Spark
reaches will do, and a lost task is written again as a whole.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, ids_of, parts_for, text_bytes

END_ID = 2
BLOCK_IDS = 1 << 21  # ids that one grammar covers, but for a longer document
LEAST = 24  # occurrences that a pair needs to become a rule
TARGET = 16 << 20
CACHE_CHUNKS = 600_000  # in each of two generations
LONG_CHUNK = 64
WORDS = 64  # chunks merged at once

_HASH_BITS = 20
_ODD_SPACE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a"
                        "\\u2028\\u2029\\u202f\\u205f\\u3000]")
_BETWEEN = re.compile(r"(?<=\S) (?=[^\s])")
_LETTER_RUN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_LETTERS = re.compile(f"({_LETTER_RUN.pattern})([!-&(-/:-@\\[-`{{-~]*)")

FILE_SCHEMA = ("shard int, block int, n_docs long, n_ids long, doc_ids binary, counts binary, "
               "begins binary, rules binary, lengths binary, symbols binary, terminals int")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


_BYTE_LETTERS = _byte_letters()
_BEGINS = (_BYTE_LETTERS[0x20], _BYTE_LETTERS[0x0A])
_LEAD, _NEXT = ("".join(map(_BYTE_LETTERS.get, r)) for r in (range(0xC3, 0xCA), range(0x80, 0xC0)))
_ACROSS = re.compile(f"(?:[A-Za-z]|(?:^|[{_LEAD}])[{_NEXT}])[{''.join(_BEGINS)}]"  # from a letter
                     f"|{_BEGINS[1]}[A-Za-z{_LEAD}]")


class IdEncoder:
    """Ids of a byte-level tokenizer, remembered per chunk of text.

    Such a tokenizer splits a text before any single blank that stands between two other
    characters, and around any single line feed that does, whatever comes before and after; the
    chunks between are encoded independently.  Chunks of Latin letters, with or without marks
    behind them, are one or two of its words and go straight to its merges, many at once: where no
    token goes on from a letter to a blank or past a line feed, no merge does.
    """

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.merges = self.library.model
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.apart = not any(map(_ACROSS.search, vocabulary))
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] in _BEGINS]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, text: str) -> np.ndarray:
        shown = text.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return np.array([t.id for t in self.merges.tokenize(shown)], np.uint32)

    def _alone(self, chunk: str) -> bytes:
        return self._ids(chunk if chunk[0] == "\n" else " " + chunk)

    def _words(self, heads: list[str]) -> list[bytes]:
        """Ids of chunks of letters, with a line feed or else the blank before them."""
        if not self.apart:
            return list(map(self._alone, heads))
        ids = self._merged("".join([h if h[0] == "\n" else " " + h for h in heads]))
        cuts = [*(np.flatnonzero(self.begins[ids]) * 4).tolist(), 4 * len(ids)]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _marks(self, marks: str) -> bytes:
        if len(marks) > 4:
            return self._ids(marks)
        out = self.marks.get(marks)
        if out is None:
            if len(self.marks) >= CACHE_CHUNKS:
                self.marks.clear()
            out = self.marks[marks] = self._ids(marks)
        return out

    def _keep(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= LONG_CHUNK:
            if len(self.young) >= CACHE_CHUNKS:
                self.old, self.young = self.young, {}
            self.young[chunk] = ids

    def _look_up(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks, with the blank before them or beginning with a line feed."""
        out: dict[str, bytes | None] = {c: self.old.get(c) for c in chunks}
        marked: dict[str, tuple[str, str]] = {}
        heads: dict[str, bytes | None] = {}
        for chunk, known in out.items():
            if known is not None:
                continue
            plain = _LETTERS.fullmatch(chunk, 1 if chunk[0] == "\n" else 0)
            if not plain:
                out[chunk] = self._alone(chunk)
                continue
            head, marks = chunk[:plain.end(1)], plain[2]
            marked[chunk] = head, marks
            if head not in heads:
                heads[head] = (self.young.get(head) or self.old.get(head)) if marks else None
        new = [h for h, known in heads.items() if known is None]
        for at in range(0, len(new), WORDS):
            part = new[at:at + WORDS]
            heads.update(zip(part, self._words(part)))
        for chunk, (head, marks) in marked.items():
            out[chunk] = heads[head] + self._marks(marks) if marks else heads[head]
        for chunk, ids in (heads | out).items():
            self._keep(chunk, ids)
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        plain = not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text
                     or text[0] == " " or text[-1] == " " or _ODD_SPACE.search(text))
        first, *rest = text.replace("\n", " \n").split(" ") if plain else _BETWEEN.split(text)
        found = list(map(self.young.get, rest))
        if None in found:
            at = [i for i, f in enumerate(found) if f is None]
            known = self._look_up([rest[i] for i in at])
            for i in at:
                found[i] = known[rest[i]]
        if first and _LETTER_RUN.fullmatch(first):
            begin = self._merged(first).tobytes()
        else:
            begin = self._ids(first)
        return np.frombuffer(begin + b"".join(found), np.uint32)


@functools.lru_cache(2)
def encoder_of(path: str) -> IdEncoder:
    """One per worker, so that what it remembers serves all its tasks."""
    return IdEncoder(path)


def _joined(left: np.ndarray, right: np.ndarray, kind: type) -> np.ndarray:
    """Pairs of symbols as numbers of the given kind, which has room for two symbols."""
    return left.astype(kind) << kind(4 * kind().nbytes) | right.astype(kind)


def _spot(own: np.ndarray) -> np.ndarray:
    """Hashed places of pairs."""
    kind = own.dtype.type
    with np.errstate(over="ignore"):
        spot = own * kind(0x9E3779B97F4A7C15 & np.iinfo(kind).max)
        return (spot >> kind(8 * own.itemsize - _HASH_BITS)).astype(np.int64)


def _numbers(pairs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``own`` are among the sorted ``pairs``, as places in ``own``, and their numbers there.

    A hashed place names one pair; only what stands at places of several is searched for.
    """
    places, spot = _spot(pairs), _spot(own)
    table = np.zeros(1 << _HASH_BITS, np.int32)
    table[places] = np.arange(len(pairs))
    number = table[spot]
    hit = pairs[number] == own
    shared = places[table[places] != np.arange(len(pairs))]
    if len(shared):
        several = np.zeros(1 << _HASH_BITS, bool)
        several[shared] = True
        rest = np.flatnonzero(several[spot])
        found = np.minimum(np.searchsorted(pairs, own[rest]), len(pairs) - 1)
        number[rest] = found
        hit[rest] = pairs[found] == own[rest]
    hit = np.flatnonzero(hit)
    return hit, number[hit]


def _frequent(symbols: np.ndarray, live: np.ndarray, least: int, kind: type):
    """Pairs that begin at ``least`` of the ``live`` places or more, most frequent first, their places
    and, for every place, the number of its pair."""
    at = np.flatnonzero(live)
    if len(at) > len(symbols) // 8:
        own = _joined(symbols[:-1], symbols[1:], kind)[live[:-1]]
    else:
        own = _joined(symbols[at], symbols[at + 1], kind)
    # Of pairs of one symbol that overlap every second one counts, from the left.
    odd = np.zeros(len(at), bool)
    same = np.flatnonzero(own >> kind(4 * own.itemsize) == own & kind((1 << 4 * own.itemsize) - 1))
    if len(same):
        run = np.concatenate([[True], np.diff(at[same]) > 1])
        first = np.maximum.accumulate(np.where(run, np.arange(len(same)), 0))
        odd[same[(np.arange(len(same)) - first) % 2 == 1]] = True
    counted = np.sort(own[~odd] if len(same) else own)
    begin = np.flatnonzero(np.concatenate([[True], counted[1:] != counted[:-1]])[:len(counted)])
    counts = np.diff(begin, append=len(counted))
    pairs, counts = counted[begin[counts >= least]], counts[counts >= least]
    if not len(pairs):
        return pairs, at[:0], at[:0], odd[:0]
    hit, place = _numbers(pairs, own)
    order = np.lexsort((pairs, -counts))
    rank = np.empty(len(pairs), np.int32)
    rank[order] = np.arange(len(pairs))
    return pairs[order], at[hit], rank[place], odd[hit]


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places are taken if the more frequent of two overlapping pairs goes first."""
    taken = np.zeros(len(at), bool)
    rest = None
    while len(at):
        near = at[1:] - at[:-1] == 1
        behind = rank[1:] < rank[:-1]
        wins = np.ones(len(at), bool)
        wins[:-1] &= ~(near & behind)
        wins[1:] &= ~(near & ~behind)
        taken[wins if rest is None else rest[wins]] = True
        beside = wins.copy()
        beside[:-1] |= near & wins[1:]
        beside[1:] |= near & wins[:-1]
        more = np.flatnonzero(~beside)
        rest = more if rest is None else rest[more]
        at, rank = at[more], rank[more]
    return taken


def compress(ids: np.ndarray, sizes: np.ndarray, rounds: int | None = None, least: int = LEAST):
    """``symbols, begins, rules, lengths, terminals`` of documents laid end to end.

    Rounds go on until no pair occurs ``least`` times, or for the given number.  A round replaces
    all frequent pairs that no more frequent one overlaps; the most frequent is always among them.
    ``begins`` has the first symbol of each document and the number of symbols.  Symbol
    ``terminals + k`` stands for the pair ``rules[k]`` and expands to ``lengths[k]`` ids.
    """
    symbols = ids.astype(np.uint32)
    terminals = int(symbols.max()) + 1 if len(symbols) else 1
    filled = sizes > 0
    last = np.cumsum(sizes)[filled] - 1  # the last symbol of a document starts no pair
    found, n_rules = [np.empty((0, 2), np.int64)], 0
    live = np.ones(len(symbols), bool)  # where a pair begins that can be frequent
    live[last] = False
    for _ in itertools.count() if rounds is None else range(rounds):
        kind = np.uint32 if terminals + n_rules <= 1 << 16 else np.uint64
        pairs, at, rank, odd = _frequent(symbols, live, least, kind)
        if not len(pairs):
            break
        live[:] = False
        live[at] = True
        if odd.any():
            at, rank = at[~odd], rank[~odd]
        taken = np.flatnonzero(_apart(at, rank))
        at, rank = at[taken], rank[taken]
        used = np.bincount(rank, minlength=len(pairs)) >= least
        named = np.cumsum(used) - 1
        some = np.flatnonzero(used[rank])
        at, rank = at[some], rank[some]
        chosen, half = pairs[used].astype(np.int64), 4 * kind().nbytes
        found.append(np.stack([chosen >> half, chosen & ((1 << half) - 1)], axis=1))
        symbols[at] = (terminals + n_rules + named)[rank]
        n_rules += len(chosen)
        live[at] = True
        live[np.maximum(at, 1) - 1] = True  # a removed symbol before it gives way to a live one
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        last -= np.searchsorted(at, last)  # symbols removed up to it
        symbols, live = symbols[keep], live[keep]
        live[last] = False
    rules = np.concatenate(found)
    lengths = _lengths(rules, terminals)
    begins = np.zeros(len(sizes) + 1, np.int64)
    begins[-1] = len(symbols)
    begins[:-1][filled] = np.concatenate([[0], last + 1])[:len(last)]
    for k in range(len(sizes) - 1, -1, -1):
        if not sizes[k]:
            begins[k] = begins[k + 1]
    return symbols, begins, rules.astype(np.uint32), lengths, terminals


def _lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    out = np.ones(terminals + len(rules), np.int64)
    lo = 0
    while lo < len(rules):  # rules of one round only name symbols of earlier ones
        hi = lo + int(np.argmax((rules[lo:] >= terminals + lo).any(axis=1))) if (
            rules[lo:] >= terminals + lo).any() else len(rules)
        out[terminals + lo:terminals + hi] = out[rules[lo:hi, 0]] + out[rules[lo:hi, 1]]
        lo = hi
    return out[terminals:].astype(np.uint32)


class Grammar:
    """Rules of a block, with every nonterminal expanded once."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, terminals: int):
        self.size = np.concatenate([np.ones(terminals, np.int64), lengths.astype(np.int64)])
        self.offset = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.flat = np.empty(int(self.size.sum()), np.uint32)
        self.flat[:terminals] = np.arange(terminals)
        for k, (a, b) in enumerate(rules.tolist()):
            at, n = self.offset[terminals + k], self.size[a]
            self.flat[at:at + n] = self.flat[self.offset[a]:self.offset[a] + n]
            self.flat[at + n:at + n + self.size[b]] = \
                self.flat[self.offset[b]:self.offset[b] + self.size[b]]

    def expand(self, symbols: np.ndarray, start: int = 0, count: int | None = None) -> np.ndarray:
        """Ids ``[start, start + count)`` of a document; only symbols that reach in are expanded."""
        size = self.size[symbols]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        stop = total if count is None else min(total, start + count)
        lo = int(np.searchsorted(ends, start, side="right"))
        hi = int(np.searchsorted(ends, stop, side="left")) + 1
        part, size, ends = symbols[lo:hi], size[lo:hi], ends[lo:hi]
        if not len(part):
            return np.empty(0, np.uint32)
        first = int(ends[0] - size[0])
        within = np.arange(int(ends[-1]) - first) - np.repeat(ends - size - first, size)
        return self.flat[np.repeat(self.offset[part], size) + within][start - first:stop - first]


def _block(shard: int, block: int, docs: list[int], parts: list[np.ndarray]) -> tuple:
    sizes = np.array([len(p) for p in parts], np.int64)
    symbols, begins, rules, lengths, terminals = compress(np.concatenate(parts), sizes)
    width = 16 if terminals + len(rules) <= 1 << 16 else 32
    return (shard, block, len(docs), int(sizes.sum()), np.array(docs, np.int64).tobytes(),
            sizes.astype(np.uint32).tobytes(), begins.tobytes(), rules.tobytes(),
            lengths.tobytes(), symbols.astype(f"u{width // 8}").tobytes(), terminals)


def _write_batches(path: str, end_id: int, block_ids: int, schema: pa.Schema):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = encoder_of(path), np.array([end_id], np.uint32)
        shard, block = TaskContext.get().partitionId(), 0
        docs: list[int] = []
        parts: list[np.ndarray] = []
        n = 0

        def flush():
            row = _block(shard, block, docs, parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in stream:
            for doc, text in zip(ids_of(batch).tolist(), batch.column("text").to_pylist()):
                docs.append(doc)
                parts.append(np.concatenate([encoder.encode(text or ""), end]))
                n += len(parts[-1])
                if n >= block_ids:
                    yield flush()
                    docs, parts, n, block = [], [], 0, block + 1
        if docs:
            yield flush()
    return run


_FILE_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
    *((k, pa.binary()) for k in ("doc_ids", "counts", "begins", "rules", "lengths", "symbols")),
    ("terminals", pa.int32())])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
          block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of ``docs(doc_id, text)``, each with ``end_id`` behind it, to a new ``path``.

    Shards are ranges of doc_id (null ids first, equal ids in one shard); rows that repeat an id
    stand next to each other, in order of their texts.  Null counts as empty and has the end id
    alone; an empty table makes a file without blocks.  ``tokenizer`` is a path that every executor
    can read.  Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    parts = parts_for(texts, text_bytes(texts), TARGET)
    blocks = (texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
              .mapInArrow(_write_batches(tokenizer, end_id, block_ids, _FILE_ARROW), FILE_SCHEMA))
    blocks.write.mode("errorifexists").parquet(path)


def _grammar(row: dict) -> tuple[Grammar, np.ndarray, np.ndarray]:
    rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
    grammar = Grammar(rules, np.frombuffer(row["lengths"], np.uint32), row["terminals"])
    wide = row["terminals"] + len(rules) > 1 << 16
    return grammar, np.frombuffer(row["symbols"], np.uint32 if wide else np.uint16), \
        np.frombuffer(row["begins"], np.int64)


def ids_of_document(row: dict, k: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """Random access: ids of the k-th document of one block row, or a range of them."""
    grammar, symbols, begins = _grammar(row)
    return grammar.expand(symbols[begins[k]:begins[k + 1]], start, count)


_READ = "shard int, block int, doc_id long, own_start long, n_tokens long, ids_crc32 long"


def _read_batches(with_ids: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in stream for r in batch.to_pylist()):
            grammar, symbols, _ = _grammar(row)
            ids = grammar.expand(symbols)
            counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
            ends = np.cumsum(counts)
            docs = np.frombuffer(row["doc_ids"], np.int64)
            n = len(docs)
            sums = [zlib.crc32(ids[a:b].astype("<u4", copy=False).tobytes())
                    for a, b in zip(ends - counts, ends)]
            columns = [pa.array(np.full(n, row["shard"], np.int32)),
                       pa.array(np.full(n, row["block"], np.int32)),
                       pa.array(docs, mask=docs == NO_ID), pa.array(ends - counts),
                       pa.array(counts), pa.array(sums, pa.int64())]
            names = ["shard", "block", "doc_id", "own_start", "n_tokens", "ids_crc32"]
            if with_ids:
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def starts(blocks: DataFrame) -> DataFrame:
    """``shard, block, before``: ids in all blocks before one.

    Blocks add up within their shard first; only one row per shard meets in the sum over shards.
    """
    blocks = blocks.select("shard", "block", "n_ids")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0))
                           .alias("shard_before"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
            .join(shards, "shard")
            .select("shard", "block", (F.col("own") + F.col("shard_before")).alias("before")))


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document in the files at ``path``.

    ``start`` counts the ids of all documents before; the checksum is taken over the expanded ids
    as little-endian 32-bit integers.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    found = blocks.drop("n_docs", "n_ids").mapInArrow(
        _read_batches(with_ids), _READ + ", ids array<int>" * with_ids)
    return found.join(starts(blocks), ["shard", "block"]).select(
        "doc_id", (F.col("own_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        *["ids"] * with_ids)
