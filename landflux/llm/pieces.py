"""SentencePiece BPE encoding and decoding, by merge rounds over flat arrays.

Supported are models of kind BPE with the identity normaliser, a dummy space in
front, kept spaces and byte fallback. All symbols of all distinct words of a
batch lie in one array. A round ranks every adjacent pair of a word, takes the
segmented minimum over each word, and merges in every word all pairs of its best
rank at once, from the left, up to the first that makes a new pair which the
sequential algorithm would take before the next; then the array is compacted. A
word without a pair in the vocabulary is done and leaves the array. So a very
long word takes a round per rank, not one per merge.
"""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Iterator
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SLICE_BYTES = 1 << 20  # text handled at once in a task
SLICE_IDS = 1 << 19  # ids decoded at once
MOST_WORDS = 100_000  # words remembered in a task


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields (number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        length = {5: 4, 1: 8}.get(kind) or number()
        yield key >> 3, data[at : at + length]
        at += length


def _among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``keys``, and whether each wanted key is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Vocabulary:
    """Pieces of a model file, what they decode to, and for encoding the ranks of all pairs."""

    def __init__(self, data: bytes) -> None:
        pieces, scores, kinds = [], [], []
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0" * 4))[0])
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                if trainer.get(3) != 2 or not trainer.get(35):
                    raise ValueError("only BPE models with byte fallback are supported")
            elif field == 3:
                normal = dict(_fields(value))
                if normal.get(1) != b"identity" or normal.get(4) != 0 or not normal.get(3, 1):
                    raise ValueError("only the identity normaliser with a dummy space is supported")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined pieces are not supported")
        self.pieces = pieces
        normal_ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
        self._normal, self._scores = normal_ids, scores
        # what each id decodes to
        self.bytes = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(pieces, kinds, strict=True)
        ]
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.byte_lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_starts = np.concatenate(([0], np.cumsum(self.byte_lengths)[:-1]))
        self.byte_pool = np.frombuffer(b"".join(self.bytes), np.uint8)

    def load_merges(self) -> None:
        """What only encoding needs: symbols, pair ranks, and where words end."""
        pieces, scores, normal_ids = self.pieces, self._scores, self._normal
        # characters of pieces that are no piece themselves get ids above the vocabulary
        self.symbols = {p: i for p, i in normal_ids.items() if len(p) == 1}
        for piece in normal_ids:
            for char in piece:
                self.symbols.setdefault(char, len(pieces) + len(self.symbols))
        self.base = len(pieces) + len(self.symbols) + 1
        order = sorted(set(scores), reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        known = {**self.symbols, **normal_ids}
        pairs = {}
        for piece, i in normal_ids.items():
            for cut in range(1, len(piece)):
                a, b = known.get(piece[:cut]), known.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (rank[scores[i]], i)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = keys
        self.pair_ranks = np.array([pairs[k][0] for k in keys.tolist()], np.int64)
        self.pair_ids = np.array([pairs[k][1] for k in keys.tolist()], np.int64)
        # no piece reaches over the start of a space run or a line end, if the vocabulary has none that does
        inner = any(SPACE in p.lstrip(SPACE) for p in normal_ids)
        lines = any("\n" in p and len(p) > 1 for p in normal_ids)
        stop = "" if lines else "\n"
        self.words = re.compile("(?s).+" if inner else f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + ("" if lines else "|\n"))
        # adjacent characters that some piece holds; a word splits exactly between all others
        joined = {p[i : i + 2] for p in normal_ids for i in range(len(p) - 1)}
        self.joined_keys = np.array(sorted(self.symbols[a] * self.base + self.symbols[b] for a, b in joined), np.int64)
        # the symbol of every code point
        self.symbol_of = np.full(sys.maxunicode + 1, self.base - 1, np.int32)
        self.symbol_of[[ord(c) for c in self.symbols]] = list(self.symbols.values())

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words laid end to end, and where each word ends, by merge rounds over all of them."""
        text = "".join(words)
        if not text:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        symbol = self.symbol_of[np.frombuffer(text.encode("utf-32-le"), "<u4")].astype(np.int64)
        place = np.arange(len(text))
        word_ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.ones(len(text), bool)
        starts[1:] = ~_among(self.joined_keys, symbol[:-1] * self.base + symbol[1:])[1]
        starts[word_ends[word_ends < len(text)]] = True
        segment = np.cumsum(starts) - 1
        segments = int(segment[-1]) + 1
        done_symbol, done_place = [], []
        while len(symbol):
            left = np.flatnonzero(segment[:-1] == segment[1:])
            at, known = _among(self.pair_keys, symbol[left] * self.base + symbol[left + 1])
            left, at = left[known], at[known]
            if not len(left):
                done_symbol.append(symbol)
                done_place.append(place)
                break
            chosen, merged = self._merges(symbol, segment, left, at)
            symbol[chosen] = merged
            stays = np.ones(len(symbol), bool)
            stays[chosen + 1] = False
            active = np.zeros(segments, bool)
            active[segment[chosen]] = True
            active = active[segment]
            finished = stays & ~active
            done_symbol.append(symbol[finished])
            done_place.append(place[finished])
            going = stays & active
            symbol, place, segment = symbol[going], place[going], segment[going]
        symbol, place = np.concatenate(done_symbol), np.concatenate(done_place)
        sort = np.argsort(place)
        symbol, place = symbol[sort], place[sort]
        ends = np.searchsorted(place, word_ends)
        fallback = symbol >= len(self.pieces)
        if fallback.any():
            encoded = [text[p].encode() for p in place[fallback].tolist()]
            counts = np.ones(len(symbol), np.int64)
            counts[fallback] = [len(e) for e in encoded]
            wide = np.repeat(fallback, counts)
            symbol = np.repeat(symbol, counts)
            symbol[wide] = self.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
            ends = np.concatenate(([0], np.cumsum(counts)))[ends]
        return symbol.astype(np.int32), ends

    def _ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; a pair that makes no piece ranks last."""
        at, known = _among(self.pair_keys, first * self.base + second)
        return np.where(known, self.pair_ranks[at], np.iinfo(np.int64).max)

    def _merges(
        self, symbol: np.ndarray, segment: np.ndarray, left: np.ndarray, at: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places to merge in this round, and the pieces they become.

        Of all pairs (``left`` places, ``at`` in the vocabulary) those of the best
        rank of their segment, from the left and without overlaps, as far as the
        sequential order would take them one after another: up to and with the
        first whose merge makes a neighbour pair of that rank or a better one.
        """
        ranks = self.pair_ranks[at]
        new = np.concatenate(([True], segment[left][1:] != segment[left][:-1]))
        best = np.minimum.reduceat(ranks, np.flatnonzero(new))[np.cumsum(new) - 1]
        left, at, best = (a[ranks == best] for a in (left, at, best))
        # in a chain of pairs that overlap every second one is left
        number = np.arange(len(left))
        chain = np.concatenate(([True], left[1:] != left[:-1] + 1))
        free = (number - np.maximum.accumulate(np.where(chain, number, 0))) % 2 == 0
        left, at, best = left[free], at[free], best[free]
        merged, own = self.pair_ids[at], segment[left]
        spoils = np.zeros(len(left), bool)
        inner = np.flatnonzero((left > 0) & (segment[left - 1] == own))
        before = symbol[left[inner] - 1]
        touches = (inner > 0) & (left[inner - 1] + 2 == left[inner])
        before[touches] = merged[inner[touches] - 1]
        spoils[inner] = self._ranks(before, merged[inner]) <= best[inner]
        after = np.minimum(left + 2, len(symbol) - 1)
        inner = np.flatnonzero((left + 2 < len(symbol)) & (segment[after] == own))
        spoils[inner] |= self._ranks(merged[inner], symbol[after[inner]]) <= best[inner]
        earlier = np.cumsum(spoils) - spoils
        starts = np.concatenate(([True], own[1:] != own[:-1]))
        taken = earlier == np.maximum.accumulate(np.where(starts, earlier, 0))
        return left[taken], merged[taken]

    def decode(self, ids: np.ndarray) -> str:
        """Text of one sequence of ids; bytes that are no UTF-8 become U+FFFD each."""
        parts, run, dummy = [], b"", True
        for i in [*np.asarray(ids).tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.bytes[i]
                continue
            while run:
                try:
                    parts.append(run.decode())
                    run = b""
                except UnicodeDecodeError as error:
                    parts.append(run[: error.start].decode() + "�")
                    run = run[error.start + 1 :]
            if i is None:
                break
            piece = self.bytes[i].decode()
            if dummy and not any(parts) and self.pieces[i].startswith(SPACE):
                piece, dummy = piece[1:], False
            parts.append(piece)
        return "".join(parts)

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of many sequences laid end to end, each with ids that came from a text."""
        lengths = self.byte_lengths[ids]
        upto = np.cumsum(lengths)
        source = np.repeat(self.byte_starts[ids] - (upto - lengths), lengths) + np.arange(lengths.sum())
        data = self.byte_pool[source].tobytes()
        stops = np.concatenate(([0], upto))[ends]
        return [data[a:b].removeprefix(b" ") for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def _slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` in the sum of ``sizes``."""
    sizes = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most)))
        yield batch.slice(start, stop - start)
        start = stop


class Numbers(dict):
    """Words in the order they were first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Encoding of whole texts that remembers its words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        vocabulary.load_merges()
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.ids = np.empty(0, np.int32)  # of all known words, laid end to end
        self.ends = np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and where each text ends."""
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        words = [self.vocabulary.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > MOST_WORDS:
            self.forget()
        before = len(self.known)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, counts.sum())
        if len(self.known) > before:
            ids, ends = self.vocabulary.encode_words(list(islice(self.known, before, None)))
            self.ends = np.concatenate([self.ends, ends + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        starts = np.concatenate(([0], self.ends[:-1]))
        lengths = (self.ends - starts)[number]
        upto = np.cumsum(lengths)
        flat = self.ids[np.repeat(starts[number] - upto + lengths, lengths) + np.arange(lengths.sum())]
        return flat, np.concatenate(([0], upto))[np.cumsum(counts)]


def _encoded(batches: Iterator[pa.RecordBatch], text: str, ids: str, model) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(Vocabulary(model.value))
    for batch in batches:
        for part in _slices(batch, pc.binary_length(batch.column(text)), SLICE_BYTES):
            flat, ends = encoder.encode(part.column(text).to_pylist())
            offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
            column = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, ids])


def _decoded(batches: Iterator[pa.RecordBatch], ids: str, text: str, model) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary(model.value)
    for batch in batches:
        for part in _slices(batch, pc.list_value_length(batch.column(ids)), SLICE_IDS):
            column = part.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            out, start = [], 0
            for row, end in zip(vocabulary.decode_flat(flat, ends), ends.tolist(), strict=True):
                try:
                    out.append(row.decode())
                except UnicodeDecodeError:
                    out.append(vocabulary.decode(flat[start:end]))
                start = end
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, text])


def _schema(df: DataFrame, without: str, added: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != without] + [added])


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows of ``docs`` with ``ids``, array<int>, of the whole text; no begin or end ids.

    A null or empty text gives an empty array. Rows are independent and none is
    dropped; a column named like ``ids`` is replaced. The model file is read by
    the driver and sent to the tasks (half a megabyte).
    """
    docs = docs.drop(ids)
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    return docs.mapInArrow(partial(_encoded, text=text, ids=ids, model=model), _schema(docs, ids, f"`{ids}` array<int>"))


def decode(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows of ``docs`` with ``text`` decoded from ``ids``; null ids give an empty text."""
    docs = docs.drop(text)
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    return docs.mapInArrow(partial(_decoded, ids=ids, text=text, model=model), _schema(docs, text, f"`{text}` string"))
