"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for.

Normalisation reads the compiled character map of the model (a double-array trie and its
replacement strings) and takes the longest prefix at every place, noting for each normalised byte
where its original begins.  Pieces are found by the library; their normalised lengths, summed up, are
looked up in that alignment.

A BPE merge never crosses a place where no piece of the vocabulary could lie.  If no piece holds a
space mark behind another character, texts fall into runs of spaces and what follows them that are
encoded independently; each task remembers the runs it met.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .common import add_column

COLUMN = "pieces"
CACHE_RUNS = 400_000
LONG_RUN = 64  # longer runs are not remembered

_MARK = "▁"
_RUN = re.compile(" +[^ ]*")
_USER_DEFINED, _BYTE = 4, 6
_SPANS = pa.struct([("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
                    ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])
SPANS_TYPE = T.StructType([
    T.StructField(k, T.ArrayType(T.IntegerType())) for k in ("ids", "starts", "ends")
] + [T.StructField("decoded", T.StringType())])


class CharacterMap:
    """Longest-prefix replacement by the compiled map of a model; an empty map changes nothing."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4:4 + size], "<u4").tolist()
        self.strings = compiled[4 + size:]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of ``text[at:]`` in the map."""
        if not self.units:
            return None
        node, best = self._child(self.units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._child(unit)
            if unit & 0x100:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.strings[best[1]:self.strings.index(b"\0", best[1])]


class Normalizer:
    """The normalisation of a model, with alignment."""

    def __init__(self, spec, own_symbols: list[bytes] = (), suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.fold = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.escape, self.suffix = spec.escape_whitespaces, suffix
        self.own = sorted(own_symbols, key=len, reverse=True)
        self.plain = not (self.map.units or self.fold or self.own or suffix) and self.prefix \
            and self.escape
        self.mark = _MARK.encode() if self.escape else b" "

    def _next(self, text: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.own:
            if text.startswith(symbol, at):
                return len(symbol), symbol
        found = self.map.longest(text, at)
        if found:
            return found
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, text[at:at + size]

    def normalize(self, text: bytes) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each of them (and the end) the place in ``text``."""
        out, places, at = bytearray(), [], 0
        if self.fold:
            while at < len(text):
                size, new = self._next(text, at)
                if new != b" ":
                    break
                at += size
        if at == len(text):
            return b"", [len(text)]

        def put(part: bytes, place: int) -> None:
            out.extend(part)
            places.extend([place] * len(part))

        if self.prefix and not self.suffix:
            put(self.mark, at)
        after_space = self.fold
        while at < len(text):
            size, new = self._next(text, at)
            if after_space and self.fold:
                new = new.lstrip(b" ")
            if new:
                for k in range(len(new)):
                    put(self.mark if new[k] == 0x20 else new[k:k + 1], at)
                after_space = new.endswith(b" ")
            if not self.fold:
                after_space = False
            at += size
        if self.fold:
            while out.endswith(self.mark):
                del out[-len(self.mark):]
                del places[-len(self.mark):]
        if self.prefix and self.suffix:
            put(self.mark, at)
        places.append(len(text) if not self.fold or not places else self._end(text, places))
        return bytes(out), places

    def _end(self, text: bytes, places: list[int]) -> int:
        size, _ = self._next(text, places[-1])
        return min(len(text), places[-1] + size)


class Encoder:
    """Ids, original byte spans and decoded text of one model, inside a task."""

    def __init__(self, model: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [p.piece for p in proto.pieces]
        self.names = names
        own = [p.piece.encode() for p in proto.pieces if p.type == _USER_DEFINED]
        self.normalizer = Normalizer(proto.normalizer_spec, own,
                                     proto.trainer_spec.treat_whitespace_as_suffix)
        bytes_ = np.array([p.type == _BYTE for p in proto.pieces])
        self.is_byte = bytes_
        #: Bytes of each piece in the normalised text; 0 where only the text can tell.
        self.width = np.array([1 if b else len(n.encode()) for n, b in zip(names, bytes_)])
        self.width[self.library.unk_id()] = 0
        #: The same in the original, if nothing but spaces was changed.
        self.plain_width = self.width - np.array(
            [0 if b else 2 * n.count(_MARK) for n, b in zip(names, bytes_)])
        self.in_runs = (
            self.normalizer.plain and proto.trainer_spec.model_type == 2 and _MARK in names
            and proto.trainer_spec.byte_fallback
            and not any(re.search(f"[^{_MARK}]{_MARK}", n) for n in names))
        self.space = self.library.piece_to_id(_MARK)
        self.known: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        """Ids of spaces and what follows them; the first space is the one the library adds."""
        ids = [self.space] if run == " " else self.library.encode(run[1:])
        out = np.array(ids, np.int32).tobytes()
        if len(run) <= LONG_RUN:
            if len(self.known) >= CACHE_RUNS:
                self.known.clear()
            self.known[run] = out
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where the bytes of each piece begin and end in ``text``."""
        if not text:
            return (np.empty(0, np.int32),) * 3
        if self.in_runs and _MARK not in text:
            known, own = self.known.get, self._run
            ids = np.frombuffer(b"".join([known(r) or own(r) for r in _RUN.findall(" " + text)]),
                                np.int32)
            ends = np.cumsum(self.plain_width[ids], dtype=np.int32) - 1  # the first space is added
            starts = np.empty_like(ends)
            starts[0], starts[1:] = 0, ends[:-1]
            return ids, starts, ends
        ids = np.array(self.library.encode(text), np.int32)
        normal, places = self.normalizer.normalize(text.encode())
        width = self.width[ids]
        if (width == 0).any():  # unknown pieces: as long as the text between their neighbours
            width = self._widths(ids, normal)
        ends = np.cumsum(width)
        where = np.array(places, np.int32)
        return ids, where[ends - width], where[ends]

    def _widths(self, ids: np.ndarray, normal: bytes) -> np.ndarray:
        out, at = [], 0
        for k, i in enumerate(ids):
            n = int(self.width[i])
            if not n:
                n = len(normal) - at
                if k + 1 < len(ids):
                    follow = self.names[ids[k + 1]].encode()
                    n = normal.index(follow, at + 1) - at
            out.append(n)
            at += n
        return np.array(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@functools.lru_cache(2)
def encoder_of(model: str) -> Encoder:
    """One per worker, so that what it remembers serves all its tasks."""
    return Encoder(model)


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                    pa.array(values.astype(np.int32, copy=False)))


def _encode_batches(model: str, rows: int = 500):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for whole in stream:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                got = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
                decoded = [encoder.decode(ids) for ids, _, _ in got]
                column = pa.StructArray.from_arrays(
                    [*(_list([g[k] for g in got]) for k in range(3)),
                     pa.array(decoded, pa.string())], fields=list(_SPANS))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, column], names=[*batch.schema.names, COLUMN])
    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """All columns of ``docs(text, ...)`` and ``pieces(ids, starts, ends, decoded)``.

    ``ids`` are those of the library for the whole text, without begin or end; ``text`` as UTF-8
    has the bytes ``[starts[i], ends[i])`` for piece i (nothing for a space that only the model
    adds; a byte piece has its byte); ``decoded`` is the library's decoding of the ids.  ``model`` is a path
    that every executor can read.  Null counts as empty, and empty texts have no pieces.  A column
    named ``pieces`` in the input is replaced.
    """
    return add_column(docs, COLUMN, SPANS_TYPE, _encode_batches(model))
