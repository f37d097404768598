"""Language-model scores from a probabilistic suffix tree over words, counted by Spark.

A state is a context of up to ``depth`` words.  It is kept if its next words differ enough from those of
the same context without its oldest word: a divergence test on the counts.  Next-word distributions
are smoothed towards the next shorter state that is kept, down to single words with one added to each
count.  A word is scored in the longest kept state that is a suffix of what stands before it.  Behind two and more
words, a next word that occurs once behind the shorter context is not counted for itself: its share
goes to the shorter context.

The texts become chunks of word hashes that stay where they are.  Level by level a chunk asks for
the counts of its word sequences: each question goes, packed and with copies inside the chunk counted
together, to the task of a range of context hashes, which adds up all chunks and answers each.
Words are numbered first, frequent ones low, so that contexts and next words take few bytes in a question.
Answers stay with their chunks.
Only contexts frequent enough on the level before are asked for.  A context whose count, known
from that level, exceeds half of a task's share is spread over several tasks by its next words; there are
at most two such contexts per task.  Nothing else of the model ever meets in one place.

Words and contexts are told apart by 64-bit hashes: of n about n**2 / 2**65 pairs are taken as equal.
Shuffle files of a level go when its answers are written; the next one doesn't read them.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import shared_dir
from .common import NO_ID, batches, ids_of, text_bytes, texts_of

DEPTH = 3  # words of the longest context
LEAST = 8  # occurrences of a context that is tested, 2 at least
COST = 1.0  # nats that each different next word of a kept context has to gain
CHUNK = 1_000_000  # tokens of a chunk
TARGET = 16 << 20  # bytes of text per chunk partition and per range of hashes
SEGMENT = 1 << 20  # bytes hashed at once

_ADAPTIVE = "spark.sql.adaptive.enabled"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if 9 <= c <= 13 else c for c in range(256))
_ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("part", pa.int32()),
                     ("body", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("body", pa.binary())])
_SCORE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("base_score", pa.float64()),
                    ("score", pa.float64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _join(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context and the word behind it."""
    with np.errstate(over="ignore"):
        return _mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


END = _mix(np.array([0x454E44], np.uint64))  # closes every text


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value per byte, and the powers of an odd number and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15 | 1
    with np.errstate(over="ignore"):
        ups, downs = (np.cumprod(np.array([1] + [b] * size, np.uint64), dtype=np.uint64)
                      for b in (base, pow(base, -1, 1 << 64)))
    return _mix(np.arange(1, 257, dtype=np.uint64)), ups, downs


def _segment_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and begins of lower-cased text whose white space is blanks."""
    b = np.frombuffer(text, np.uint8)
    values, ups, downs = _powers(max(SEGMENT, 1 << len(b).bit_length()))
    word = np.concatenate([[False], b != 0x20, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64),
                               np.cumsum(values[b] * ups[:len(b)], dtype=np.uint64)])
        return _mix((sums[end] - sums[begin]) * downs[begin]), begin


def word_hashes(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Hashes of the words of every text, several short texts at once, long ones in segments."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        h, begin = _segment_hashes(b" ".join(held))
        ends = np.cumsum([len(t) + 1 for t in held])
        yield from np.split(h, np.searchsorted(begin, ends[:-1]))

    for text in texts:
        text = (text or b"").translate(_LOWER)
        if held and size + len(text) > SEGMENT:
            yield from flush()
            held, size = [], 0
        if len(text) <= SEGMENT:
            held.append(text)
            size += len(text) + 1
            continue
        found, at = [], 0
        while at < len(text):
            cut = text.rfind(b" ", at, at + SEGMENT)
            if cut <= at:
                cut = text.find(b" ", at + 1)
            cut = len(text) if cut < 0 or at + SEGMENT >= len(text) else cut
            found.append(_segment_hashes(text[at:cut])[0])
            at = cut
        yield np.concatenate(found)
    if held:
        yield from flush()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, one behind the other."""
    parts = []
    for a in arrays:
        flat = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else a
        parts.append(zstandard.ZstdCompressor(level=1).compress(flat.tobytes()))
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def unpack(body: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(body[:8 * len(kinds)], np.int64)
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), map(np.dtype, kinds)):
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[at:at + size]), np.uint8)
        at += size
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
                   if len(flat) else np.empty(0, kind))
    return out


def _steps(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_hashes, prepend=np.uint64(0))


def _steps_in(runs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Differences inside runs of the given lengths; the first value of a run as it is."""
    begin = (np.cumsum(runs) - runs)[runs > 0]
    out = np.diff(values, prepend=np.zeros(1, values.dtype))
    out[begin] = values[begin]
    return out


def _sums_in(runs: np.ndarray, steps: np.ndarray) -> np.ndarray:
    runs = runs[runs > 0]
    begin = np.cumsum(runs) - runs
    total = np.cumsum(steps, dtype=steps.dtype)
    return total - np.repeat(total[begin] - steps[begin], runs)


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Places of counts, the highest first, equal ones in order."""
    return np.argsort(-counts, kind="stable")


def _rank(counts: np.ndarray) -> np.ndarray:
    out = np.empty(len(counts), np.int64)
    out[_by_count(counts)] = np.arange(len(counts))
    return out


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes: in order for sorted hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


@dataclass
class Chunk:
    """Pieces of texts: ``u`` has the word hashes in order, ``inv`` the tokens as places in ``u``.

    A piece that goes on with a text begins with ``leads`` tokens of the piece before, as context.
    Packed tokens are ranks by frequency, which take fewer bytes than places.
    """

    rows: np.ndarray
    docs: np.ndarray
    sizes: np.ndarray
    leads: np.ndarray
    train: np.ndarray
    u: np.ndarray
    inv: np.ndarray

    def pack(self) -> bytes:
        often = np.bincount(self.inv, minlength=len(self.u))
        rank = _rank(often)
        return pack(self.rows, self.docs, self.sizes, self.leads, self.train, _steps(self.u),
                    often.astype(np.int32), rank[self.inv].astype(np.int32))

    @staticmethod
    def unpack(body: bytes) -> Chunk:
        *rest, u, often, rank = unpack(body, np.int64, np.int64, np.int64, np.int64, np.uint8,
                                       np.uint64, np.int32, np.int32)
        return Chunk(*rest, np.cumsum(u, dtype=np.uint64), _by_count(often)[rank])

    def __post_init__(self):
        begins = np.cumsum(self.sizes) - self.sizes
        self.index = np.arange(len(self.inv)) - np.repeat(begins, self.sizes)
        self.own = self.index >= np.repeat(self.leads, self.sizes)
        self.learn = self.own & np.repeat(self.train.astype(bool), self.sizes)


def _chunk_batches(size: int, depth: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        tokens: list[np.ndarray] = []
        meta: list[tuple] = []
        held = number = row = 0

        def made():
            u, inv = np.unique(np.concatenate(tokens), return_inverse=True)
            r, d, n, lead, train = (np.array(x, np.int64) for x in zip(*meta))
            return task + number, Chunk(r, d, n, lead, train.astype(np.uint8), u, inv).pack()

        def rows():
            nonlocal tokens, meta, held, number, row
            for batch in stream:
                trains = batch.column("train").to_pylist()
                for h, doc, train in zip(word_hashes(texts_of(batch)), ids_of(batch).tolist(),
                                         trains):
                    h = np.concatenate([h, END])
                    at = 0
                    while at < len(h):
                        lead = min(depth, at)
                        end = min(len(h), at + max(size - held, 1))
                        tokens.append(h[at - lead:end])
                        meta.append((task + row, doc, end - at + lead, lead, bool(train)))
                        held += end - at
                        at = end
                        if held >= size:
                            yield made()
                            tokens, meta, held, number = [], [], 0, number + 1
                    row += 1
            if meta:
                yield made()
        yield from batches(rows(), _CHUNK, 1)
    return run


@dataclass
class Level:
    """The word sequences of one length in a chunk, by context and next word.

    ``pos``: tokens behind a context frequent enough; ``context``: the number of that context.
    ``names``, ``hashes``, ``counts``, ``shorter``, ``solos``: per context, in order of the numbers of its
    words, these numbers (an array per word), a hash of them, its count, that of the context without
    its oldest word, and its next words that need no question.
    ``asked``: which of ``pos`` need one; ``event``: the place of their sequence, in order of
    context and number of the next word.
    """

    pos: np.ndarray
    context: np.ndarray
    names: list[np.ndarray]
    hashes: np.ndarray
    counts: np.ndarray
    shorter: np.ndarray
    solos: np.ndarray
    asked: np.ndarray
    event: np.ndarray
    event_context: np.ndarray
    event_number: np.ndarray  # of the next word
    event_shorter: np.ndarray  # count of the next word behind the shorter context
    event_part: np.ndarray
    part: np.ndarray
    hot: np.ndarray

    def deal(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sequences in order of part and context; every part and context that go together, in
        order, as one number; and where the sequences of each begin and end."""
        size = max(len(self.hashes), 1)
        order = np.argsort(self.event_part, kind="stable")
        pairs = (self.event_part * size + self.event_context)[order]
        every = np.union1d(pairs, self.part * size + np.arange(len(self.hashes)))
        return (order, every, np.searchsorted(pairs, every, "left"),
                np.searchsorted(pairs, every, "right"))


@dataclass
class Model:
    """What is known of the whole corpus: sizes, and the split contexts of each level."""

    depth: int
    least: int
    cost: float
    parts: int
    n: int = 0
    v: int = 0
    hot: dict | None = None  # level: hashes in order, and what is kept of these contexts

    def limit(self) -> float:
        """Count from which a context is split."""
        return max(self.n / (2 * self.parts), 1)

    def kept(self, counts, shorter, gain, words, solos) -> np.ndarray:
        """The divergence test: next words per context and the share of the shorter context, which has
        those counted nowhere else too; both 0 where the context isn't kept."""
        with np.errstate(divide="ignore", invalid="ignore"):
            divergence = gain + counts * (np.log(shorter) - np.log(counts))
        good = (counts >= self.least) & (divergence >= self.cost * words)
        return np.where(good, [words, words + solos], 0)


def _walk(chunk: Chunk, model: Model, answers: dict[int, list[bytes]], upto: int,
          asking: bool = False) -> Iterator[tuple[Level, np.ndarray | None, np.ndarray | None]]:
    """Levels 1, 2, ...: the level, the counts behind its tokens, and the next words and the share of
    the shorter context for its kept contexts; when asking, the last one has no answers yet.

    A sequence whose shorter sequence never occurs in training doesn't either.  From two words on,
    one whose shorter sequence occurs once stands for itself nowhere; at a token that is learned
    from it is known to occur once too.  None of these is asked for.
    """
    word_counts, numbers = _words_of(answers, chunk, model.parts)
    order = np.argsort(numbers)
    u, word_counts, numbers = chunk.u[order], word_counts[order], numbers[order]
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    inv = place[chunk.inv]
    now, shorter_now = word_counts[inv], np.full(len(inv), model.n)
    event, totals = inv, word_counts
    names, hashes = [numbers], _named([numbers])
    for k in range(1, upto + 1):
        before = np.zeros(len(now), np.int64)
        before[1:] = now[:-1]
        pos = np.flatnonzero((chunk.index >= k) & (before >= model.least))
        ids = event[pos - 1]
        seen = np.zeros(len(hashes), bool)
        seen[ids] = True
        used = np.flatnonzero(seen)
        rank = np.zeros(len(hashes), np.int64)
        rank[used] = np.arange(len(used))
        context = rank[ids]
        shorter = np.zeros(len(used), np.int64)
        shorter[context] = shorter_now[pos - 1]
        solo = (now[pos] == 1) & chunk.learn[pos] & (k > 1)
        asked = now[pos] >= min(k, 2)
        pairs, ev = np.unique(context[asked] * len(u) + inv[pos[asked]], return_inverse=True)
        e_context, e_word = np.divmod(pairs, max(len(u), 1))
        e_shorter = np.zeros(len(pairs), np.int64)
        e_shorter[ev] = now[pos[asked]]
        counts = totals[used]
        salts = np.minimum(np.ceil(counts / model.limit()), model.parts).astype(np.int64)
        part = _part_of(hashes[used], model.parts)
        spread = (_mix(u[e_word]) >> np.uint64(1)).astype(np.int64) % salts[e_context]
        level = Level(pos, context, [x[used] for x in names], hashes[used], counts, shorter,
                      np.bincount(context[solo], minlength=len(used)), asked, ev, e_context,
                      numbers[e_word], e_shorter, (part[e_context] + spread) % model.parts, part, salts > 1)
        if asking and k == upto:
            yield level, None, None
            return
        got, kept = np.zeros(len(pairs), np.int64), np.zeros((2, len(used)), np.int64)
        order, every, _, _ = level.deal()
        found = [unpack(b, np.int64, np.int32, np.int32) for b in answers.get(k, ())]
        if found:
            got[order] = np.concatenate([c for c, _, _ in found])
            kept[:, every % max(len(used), 1)] = [np.concatenate(x) for x in list(zip(*found))[1:]]
        if level.hot.any():
            known, told = model.hot[k]
            hot = np.flatnonzero(level.hot)
            kept[:, hot] = told[:, np.searchsorted(known, level.hashes[hot])]
        behind = np.zeros(len(pos), np.int64)
        behind[asked] = got[ev]
        yield level, behind, kept
        shorter_now, now = now, np.zeros(len(now), np.int64)
        now[pos] = np.where(solo, 1, behind)
        event = np.zeros(len(now), np.int64)
        event[pos[asked]] = ev
        names = [*(x[e_context] for x in level.names), level.event_number]
        hashes = _join(level.hashes[e_context], level.event_number.view(np.uint64))
        totals = got


def _named(names: list[np.ndarray]) -> np.ndarray:
    """Hashes of contexts by the numbers of their words, an array per word."""
    out = _mix(names[0].view(np.uint64))
    for x in names[1:]:
        out = _join(out, x.view(np.uint64))
    return out


def _words_of(answers: dict[int, list[bytes]], chunk: Chunk,
              parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and numbers of the words of a chunk, in order of their hashes."""
    counts, ranks = (np.concatenate(x) for x in zip(*(unpack(b, np.int64, np.int64)
                                                      for b in answers[0])))
    return counts, ranks * parts + _part_of(chunk.u, parts)


def _sums(ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(ids, weights=n, minlength=size).astype(np.int64)  # exact up to 2**53


def _ask_words(parts: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table) -> pa.Table:
        chunk = Chunk.unpack(left.column("body")[0].as_py())
        n = np.bincount(chunk.inv[chunk.learn], minlength=len(chunk.u)).astype(np.int64)
        part = _part_of(chunk.u, parts)
        cut = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
        rows = [(int(part[a]), key[0].as_py(), pack(_steps(chunk.u[a:b]), n[a:b]))
                for a, b in zip(cut, cut[1:])]
        return pa.Table.from_batches(batches(iter(rows), _ASK, 1000), _ASK)
    return run


def _answer_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    got = [unpack(b, np.uint64, np.int64) for b in table.column("body").to_pylist()]
    hashes, ids = np.unique(np.concatenate([np.cumsum(h, dtype=np.uint64) for h, _ in got]),
                            return_inverse=True)
    total = _sums(ids, np.concatenate([n for _, n in got]), len(hashes))
    part, at, rows, rank = key[0].as_py(), 0, [], _rank(total)
    for chunk, (h, _) in zip(table.column("chunk").to_pylist(), got):
        own = ids[at:at + len(h)]
        rows.append((chunk, 0, part, pack(total[own], rank[own]), None, None))
        at += len(h)
    rows.append((-1, 0, part, None, int(total.sum()), int((total > 0).sum())))
    return pa.Table.from_batches(batches(iter(rows), _ANSWER, 1000), _ANSWER)


def _answers_of(table: pa.Table) -> dict[int, list[bytes]]:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("level", "part", "body"))),
                  key=lambda r: r[:2])
    out: dict[int, list[bytes]] = {}
    for level, _, body in rows:
        out.setdefault(level, []).append(body)
    return out


def _ask_contexts(model: Model, k: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk.unpack(left.column("body")[0].as_py())
        *_, (level, _, _) = _walk(chunk, model, _answers_of(right), k, asking=True)
        n = np.bincount(level.event[chunk.learn[level.pos[level.asked]]],
                        minlength=len(level.event_number)).astype(np.int64)
        words = level.event_number
        order, every, begin, end = level.deal()
        part, context = np.divmod(every, max(len(level.hashes), 1))
        cut = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
        rows = []
        for a, b in zip(cut, cut[1:]):
            c, at = context[a:b], order[begin[a]:end[b - 1]]
            runs = end[a:b] - begin[a:b]
            rows.append((int(part[a]), key[0].as_py(), pack(
                np.diff(level.names[0][c], prepend=0), *(x[c] for x in level.names[1:]), runs,
                level.shorter[c],
                np.where(level.part[c] == part[a], level.solos[c], 0), level.hot[c].view(np.uint8),
                _steps_in(runs, words[at]), n[at], level.event_shorter[at])))
        return pa.Table.from_batches(batches(iter(rows), _ASK, 1000), _ASK)
    return run


def _answer_contexts(model: Model, k: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [unpack(b, *[np.int64] * (k + 3), np.uint8, *[np.int64] * 3)
               for b in table.column("body").to_pylist()]
        hashes = np.concatenate([_named([np.cumsum(g[0]), *g[1:k]]) for g in got])
        lengths, shorter, solos, hot, words, n, e_shorter = (
            np.concatenate(x) for x in list(zip(*got))[k:])
        words = _sums_in(lengths, words)
        known, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        pairs, e_first, e_ids = np.unique(
            _join(np.repeat(hashes, lengths), words.view(np.uint64)),
            return_index=True, return_inverse=True)
        total = _sums(e_ids, n, len(pairs))
        some = total > 0
        c = np.repeat(ids, lengths)[e_first][some]
        t, s = total[some].astype(float), e_shorter[e_first][some]
        size = len(known)
        counts, gain = (np.bincount(c, weights=w, minlength=size)
                        for w in (t, t * (np.log(t) - np.log(s))))
        alone = np.bincount(ids, weights=solos, minlength=size).astype(np.int64)
        counts, nexts = counts + alone, np.bincount(c, minlength=size) + alone
        split = hot[first].astype(bool)
        kept = np.where(split, 0, model.kept(counts, shorter[first], gain, nexts, alone)) \
            .astype(np.int32)
        part, rows, at, e_at = key[0].as_py(), [], 0, 0
        for chunk, g in zip(table.column("chunk").to_pylist(), got):
            rows.append((chunk, k, part, pack(total[e_ids[e_at:e_at + len(g[-1])]],
                                              *(x[ids[at:at + len(g[0])]] for x in kept)), None, None))
            at, e_at = at + len(g[0]), e_at + len(g[-1])
        if split.any():
            rows.append((-1, k, part, pack(known[split], counts[split], shorter[first][split],
                                           gain[split], nexts[split], alone[split]), None, None))
        return pa.Table.from_batches(batches(iter(rows), _ANSWER, 1000), _ANSWER)
    return run


def _split_contexts(model: Model, answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the split contexts and what is kept of them: at most two per part and level."""
    bodies = [r.body for r in answers.where("chunk < 0").select("body").collect()]
    if not bodies:
        return np.empty(0, np.uint64), np.empty((2, 0), np.int64)
    h, c, s, g, w, n = (np.concatenate(x) for x in zip(*(
        unpack(b, np.uint64, np.float64, np.int64, np.float64, np.int64, np.int64)
        for b in bodies)))
    known, first, ids = np.unique(h, return_index=True, return_inverse=True)
    c, g, w, n = (np.bincount(ids, weights=x) for x in (c, g, w, n))
    return known, model.kept(c, s[first], g, w, n).astype(np.int64)


def _score_chunk(model: Model):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, answers = Chunk.unpack(left.column("body")[0].as_py()), _answers_of(right)
        counts = _words_of(answers, chunk, model.parts)[0][chunk.inv]
        base = (counts + 1) / (model.n + model.v + 1)
        p = base.copy()
        for level, behind, kept in _walk(chunk, model, answers, model.depth):
            good = kept[0][level.context] > 0
            at, context = level.pos[good], level.context[good]
            words, share = kept[:, context]
            p[at] = (behind[good] + share * p[at]) / (level.counts[context] + words)
        begins = np.cumsum(chunk.sizes) - chunk.sizes
        known = ((counts > 0) & chunk.own).astype(np.int64)
        sums = [np.add.reduceat(x, begins) for x in (
            known, np.log10(base) * chunk.own, np.log10(p) * chunk.own)]
        return pa.Table.from_arrays(
            [pa.array(chunk.rows), pa.array(chunk.docs), pa.array(chunk.sizes - chunk.leads),
             *map(pa.array, sums)], schema=_SCORE)
    return run


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(docs: DataFrame, train: Column, depth: int = DEPTH, least: int = LEAST,
          cost: float = COST, chunk: int = CHUNK, target: int = TARGET) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each of
    ``docs(doc_id, text)``, learning from the rows where ``train`` is true.

    Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end per text.
    ``n_known`` tokens occur in training, ``train_tokens`` is the number of all training tokens.
    ``base_score`` sums log10((count + 1) / (train_tokens + words known + 1)); ``score`` sums log10 of
    the smoothed probability in the longest kept context.  For every context the probabilities of
    all known words, the end and one unknown word add up to 1.

    A null text is empty: one token, the end.  A row whose ``train`` is null isn't learned from.
    Every row counts and is scored for itself, so a repeated row counts twice and a null doc_id stays null.
    Texts longer than a chunk are scored in pieces that overlap by a context.  With no training
    row every word is unknown; an empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.coalesce(train, F.lit(False)).alias("train"))
    parts = int(max(spark.sparkContext.defaultParallelism, -(-text_bytes(docs) // target)))
    model = Model(depth, max(least, 2), cost, parts, hot={})

    def dealt(df: DataFrame) -> DataFrame:
        """By chunk, as a checkpoint: joins then move nothing.  It only remembers its partitioning if
        the plan behind it is not adaptive."""
        with _setting(spark, _ADAPTIVE, "false"), _setting(spark, _CLEANUP, "true"):
            return df.repartition(parts, "chunk").checkpoint()

    def answered(asks: DataFrame, fn) -> DataFrame:
        return dealt(asks.repartition(parts, "part").groupBy("part")
                     .applyInArrow(fn, _ddl(_ANSWER)))

    chunks = dealt(texts.mapInArrow(_chunk_batches(chunk, depth), _ddl(_CHUNK)))
    answers = answered(chunks.groupBy("chunk").applyInArrow(_ask_words(parts), _ddl(_ASK)),
                       _answer_words)
    totals = answers.where("chunk < 0").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    model.n, model.v = totals.n or 0, totals.v or 0

    def joined(fn, schema: pa.Schema) -> DataFrame:
        # A filter on a union would lose its partitioning; sums over all chunks have none of their own.
        def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            return fn(key, left, right) if left.num_rows else schema.empty_table()

        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")) \
            .applyInArrow(run, _ddl(schema))

    for k in range(1, depth + 1):
        new = answered(joined(_ask_contexts(model, k), _ASK), _answer_contexts(model, k))
        model.hot[k] = _split_contexts(model, new)
        answers = answers.unionAll(new)
    pieces = joined(_score_chunk(model), _SCORE)
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return pieces.groupBy("row", "doc_id").agg(
        *[F.sum(c).alias(c) for c in _SCORE.names[2:]]).select(
        doc_id.alias("doc_id"), "n_tokens", "n_known",
        F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
