"""Periodic runs of words, found by string synchronising sets.

A run is a longest stretch of words with a smallest period q, as long as two
periods and ``LEAST`` words at least. All runs of every text are found; the result
does not depend on a hash.

* Periods under ``SMALL`` are looked for one by one: words are compared with those
  q places on. These scans also find the highly periodic regions.
* For longer ones there is a synchronising set at each scale t = 8, 16, 32, ...:
  of the substrings of t words that lie in no region of period t/3 or less, place i
  is taken if the substring at i or at i + t has the least hash of all that start
  from i to i + t. Whether a place is taken follows from the 2t words after it, so
  equal contexts are taken alike, and every t places one is taken unless a highly
  periodic region covers them.
* Pairs of taken places with equal contexts of 2t words, 3t to 6t places apart,
  propose their distance as a period. Equal contexts are over t/3 apart, so a place
  has 18 partners at most. Each proposal is extended word by word to both sides.
* A square of period q whose half is highly periodic may hold no pair. Its halves
  then lie in two neighbouring regions of one period r and one root, and all such
  q, r apart from each other, follow from the regions' ends.

Texts of a slice are laid end to end with a sign of its own after each, the longest
first, so that the texts long enough for a period are a prefix. The work is in
proportion to the number of words times the number of scales.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from landflux.llm.batches import slices
from landflux.llm.store import other_columns

LEAST = 12
SMALL = 24  # periods below are scanned; 3 * FIRST_SCALE
FIRST_SCALE = 8
SLICE_BYTES = 1 << 21
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[2]
    return x ^ (x >> np.uint64(29))


def _all_of(flags: np.ndarray, width: int) -> np.ndarray:
    """Places from which ``width`` flags in a row are set."""
    reach = 1
    while reach * 2 <= width:
        flags = flags[:-reach] & flags[reach:]
        reach *= 2
    rest = width - reach
    return flags[: len(flags) - rest] & flags[rest:] if rest else flags


def _stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each group of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate(([0], cuts + 1))], places[np.concatenate((cuts, [len(places) - 1]))]


class Words:
    """Word numbers of some texts laid end to end, the longest first, each followed by a sign of its own."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        total = int((lengths + 1).sum())
        self.data = np.empty(total, np.int64)
        for k, i in enumerate(self.order.tolist()):
            at = self.starts[k]
            self.data[at : at + self.lengths[k]] = texts[i]
            self.data[at + self.lengths[k]] = -1 - k
        self.found: list[np.ndarray] = []  # (start, end, period) of runs and of shorter highly periodic regions

    def prefix(self, words: int) -> int:
        """End of the texts of ``words`` words or more."""
        n = int(np.searchsorted(-self.lengths, -words, side="right"))
        return int(self.starts[n - 1] + self.lengths[n - 1] + 1) if n else 0

    def runs(self) -> np.ndarray:
        """All runs as rows of (start, end, period) in the laid-out words, by start and period."""
        self._scan()
        scale = FIRST_SCALE
        while self.prefix(6 * scale):
            self._regions(self._known(), scale)
            self._synchronise(scale)
            scale *= 2
        runs = self._known()
        runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(LEAST, 2 * runs[:, 2])]
        return runs[np.lexsort((runs[:, 2], runs[:, 0]))]

    def _known(self) -> np.ndarray:
        """What has been found, each stretch once with its smallest period."""
        if not self.found:
            return np.empty((0, 3), np.int64)
        rows = np.concatenate(self.found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        again = np.zeros(len(rows), bool)
        again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        self.found = [rows[~again]]
        return self.found[0]

    def _add(self, start, end, period) -> None:
        start = np.asarray(start, np.int64)
        if len(start):
            period = np.broadcast_to(np.asarray(period, np.int64), start.shape)
            self.found.append(np.stack([start, np.asarray(end, np.int64), period], axis=1))

    def _scan(self) -> None:
        for q in range(1, SMALL):
            # of periods 1 and 2, stretches of 8 words are regions at the first scale
            least = FIRST_SCALE if 3 * q <= FIRST_SCALE else max(LEAST, 2 * q)
            stop = self.prefix(least)
            if not stop:
                break
            same = self.data[: stop - q] == self.data[q:stop]
            width = least - q
            if len(same) >= width and len(places := np.flatnonzero(_all_of(same, width))):
                first, last = _stretches(places)
                self._add(first, last + width + q, q)

    def _synchronise(self, t: int) -> None:
        stop = self.prefix(6 * t)
        data = self.data[:stop]
        if len(data) < 3 * t:
            return
        mask = self._covered(t, stop)
        hashes = _mixed(data.view(np.uint64) * MIX[0])
        reach = 1
        while reach < t:
            hashes = _mixed(hashes[:-reach] * MIX[0] + hashes[reach:] * MIX[1])
            reach *= 2
        contexts = hashes[:-t] * MIX[0] + hashes[t:] * MIX[1]
        names = np.where(mask[: len(hashes)], TOP, hashes)
        least, reach = names, 1
        while reach < t:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[:-1], least[1:])  # of t + 1 names
        n = min(len(least), len(contexts))
        least = least[:n]
        taken = (least != TOP) & ((names[:n] == least) | (names[t : t + n] == least))
        places = np.flatnonzero(taken)
        owner = np.searchsorted(self.starts, places, side="right")
        keys = _mixed(contexts[places] ^ (owner.astype(np.uint64) * MIX[1]))
        by_key = np.argsort(keys, kind="stable")
        places, keys = places[by_key], keys[by_key]
        pairs, step = [], 1
        while step < len(places):
            apart = places[step:] - places[:-step]
            same = (keys[step:] == keys[:-step]) & (apart < 6 * t)
            if not same.any():
                break
            near = same & (apart >= 3 * t)
            pairs.append(np.stack([apart[near], places[:-step][near]], axis=1))
            step += 1
        if pairs:
            self._extend(np.concatenate(pairs))

    def _covered(self, t: int, stop: int) -> np.ndarray:
        """Places at which a substring of t words has a period of t/3 or less."""
        known = self._known()
        known = known[(3 * known[:, 2] <= t) & (known[:, 1] - known[:, 0] >= t) & (known[:, 0] < stop)]
        if not len(known):
            return np.zeros(stop, bool)
        change = np.zeros(stop + 1, np.int32)
        np.add.at(change, known[:, 0], 1)
        np.add.at(change, np.minimum(known[:, 1] - t + 1, stop), -1)
        return np.cumsum(change[:-1]) > 0

    def _extend(self, pairs: np.ndarray) -> None:
        """Follow each (period, place) to both sides while words a period apart are equal."""
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        period, upto, rows = 0, -1, []
        for q, place in pairs.tolist():
            if q == period and place < upto:
                continue  # in the stretch just followed
            low, high = self._back(place, q), self._ahead(place, q)
            period, upto = q, high
            if high - low >= q:
                rows.append((low, high + q, q))
        if rows:
            self.found.append(np.array(rows, np.int64))

    def _ahead(self, place: int, q: int) -> int:
        """The first place from ``place`` on whose word differs from that q on."""
        width, end = 64, len(self.data) - q
        while place < end:
            stop = min(place + width, end)
            off = np.flatnonzero(self.data[place:stop] != self.data[place + q : stop + q])
            if len(off):
                return place + int(off[0])
            place, width = stop, width * 2
        return end

    def _back(self, place: int, q: int) -> int:
        """The least place from which all words up to ``place`` equal those q on."""
        width = 64
        while place > 0:
            begin = max(place - width, 0)
            off = np.flatnonzero(self.data[begin:place] != self.data[begin + q : place + q])
            if len(off):
                return begin + int(off[-1]) + 1
            place, width = begin, width * 2
        return 0

    def _regions(self, known: np.ndarray, t: int) -> None:
        """Runs of 3t to 6t words a period between two neighbouring regions of one small period and root.

        Words from ``low`` to ``high`` equal those q on, as both sides follow the
        same root. A stretch that goes on beyond the regions holds a pair of
        synchronised places and is left to them.
        """
        regions = known[(3 * known[:, 2] <= t) & (known[:, 1] - known[:, 0] >= 3 * t)]
        regions = regions[np.lexsort((regions[:, 0], regions[:, 2]))]
        if len(regions) < 2:
            return
        one, two = regions[:-1], regions[1:]
        near = (one[:, 2] == two[:, 2]) & (two[:, 0] <= one[:, 1])
        for (h0, h1, r), (g0, g1, _) in zip(one[near].tolist(), two[near].tolist(), strict=True):
            root = self.data[g0 : g0 + r]
            turned = [x for x in range(r) if np.array_equal(self.data[h0 + x : h0 + x + r], root)]
            if not turned:
                continue
            # words at h0 + x and at g0 start the same root
            shift = (g0 - h0 - turned[0]) % r
            q = np.arange(3 * t + (shift - 3 * t) % r, 6 * t, r)
            low, high = np.maximum(h0, g0 - q), np.minimum(h1, g1 - q)
            keep = high - low >= q
            q, low, high = q[keep], low[keep], high[keep]
            before, beyond = np.maximum(low - 1, 0), np.minimum(high + q, len(self.data) - 1)
            longer = (low > 0) & (self.data[before] == self.data[before + q])
            longer |= (high + q < len(self.data)) & (self.data[high] == self.data[beyond])
            self._add(low[~longer], (high + q)[~longer], q[~longer])


def split_words(text: str | None) -> list[bytes]:
    """Words of a text: what lies between ASCII white space."""
    return (text or "").encode().split()


def periodic_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For every list of words its runs as rows of (start, length, period), by start and period."""
    lengths = [len(t) for t in texts]
    flat = pa.array([w for t in texts for w in t], pa.binary())
    numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    words = Words([numbers[end - n : end] for n, end in zip(lengths, ends.tolist(), strict=True)])
    runs = words.runs()
    owner = np.searchsorted(words.starts, runs[:, 0], side="right") - 1
    by_owner = np.argsort(owner, kind="stable")
    runs, owner = runs[by_owner], owner[by_owner]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(texts)
    for k, i in enumerate(words.order.tolist()):
        mine = runs[edges[k] : edges[k + 1]]
        if len(mine):
            start = mine[:, 0] - words.starts[k]
            out[i] = np.stack([start, mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)
    return out


def left_by(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words made periodic from some place on, in every tenth document by the checksum of its id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RESULTS = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """The rows of ``docs`` with n_words, runs (start, length, period) and collapsed.

    ``docs`` needs text, and doc_id if runs are to be planted. collapsed joins by
    one space the words that stay when every run is cut to its first period. A
    null or empty text has no words and no runs. Rows are judged one by one:
    repeated rows and rows without an id are rows like others, an empty table stays
    empty. Columns named like a result are replaced, others passed on. A task holds
    some texts at a time, one at least, and about 100 bytes a word of them.
    """
    own = other_columns(docs, list(RESULTS))
    kept = docs.select(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column("text")), SLICE_BYTES):
                texts = [split_words(t) for t in part.column("text").to_pylist()]
                if plant:
                    texts = [planted(t, i) for t, i in zip(texts, part.column("doc_id").to_pylist(), strict=True)]
                found = periodic_runs(texts)
                collapsed = []
                for words, runs in zip(texts, found, strict=True):
                    if len(runs):
                        words = [words[i] for i in np.flatnonzero(left_by(runs, len(words))).tolist()]
                    collapsed.append(b" ".join(words).decode())
                rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
                flat = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
                offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in own),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), flat),
                        pa.array(collapsed, pa.string()),
                    ],
                    names=[*own, *RESULTS],
                )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"{n} {k}" for n, k in RESULTS.items()])
    return kept.mapInArrow(run, schema)
