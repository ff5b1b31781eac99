"""Passages that repeat anywhere, found by anchors and groups of equal hashes.

A byte is removed if it lies in a string of ``length`` bytes that starts at
another place too. Sorting all suffixes is out of the question, and so is a
merge that moves every suffix once for each of up to ``length`` characters. Two
things shorten it:

* Only suffixes at anchors take part. An anchor is a place whose 8-byte hash is
  the smallest for ``radius`` bytes around it, so whether a place is one is
  decided by its context, and equal strings have equal anchors inside. Between
  neighbouring anchors the windows of ``length`` bytes form runs with the same
  inner anchors; a run is carried as one row.
* The interleave of the shards is refined in rounds of growing depth, and what
  is alone in its interval after a round leaves the merge. Within an interval no
  order is needed to find repeats, so a prefix is known by its hash, and the
  sizes of intervals are sums that each task adds up before the shuffle.

Round 1 has the depth of a context and looks at anchors. Round 2 has the depth
of the string between a run's first and last inner anchor (the common prefix of
all its windows), round 3 that of the whole run: if it repeats, all its windows
do. Round 4 goes to single windows, but only for runs that round 2 leaves in an
interval and round 3 does not; of runs that repeat as a whole one stands for all.
Windows without an inner anchor go through rounds 2 and 3 one by one. Hashes of
rounds 2 and 3 together, and of round 4, have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landflux.llm.batches import slices
from landflux.llm.store import Store, other_columns, sets_aside

LENGTH = 400
GRAM = 8
SLICE_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def radius_of(length: int) -> int:
    return max(1, (length - GRAM) // 8)


class Texts:
    """Texts of some rows laid end to end, with their anchors."""

    def __init__(self, texts: list[bytes | None], radius: int) -> None:
        self.data = b"".join(t or b"" for t in texts)
        self.ends = np.cumsum([len(t or b"") for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.radius = radius
        self.anchors = self._anchors()
        self.owner = np.searchsorted(self.ends, self.anchors, side="right")

    def _anchors(self) -> np.ndarray:
        count, wide = len(self.data) - GRAM + 1, 2 * self.radius + 1
        if count < wide:
            return np.empty(0, np.int64)
        grams = np.ndarray((count,), "<u8", self.data, strides=(1,))
        hashes = ((grams * ODD) >> np.uint64(32)).astype(np.uint32)
        least, reach = hashes, 1
        while reach * 2 <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[: count - wide + 1], least[wide - reach : count - reach + 1])
        at = np.flatnonzero(hashes[self.radius : self.radius + len(least)] == least) + self.radius
        owner = np.searchsorted(self.ends, at, side="right")
        inside = (at - self.radius >= self.starts[owner]) & (at + self.radius + GRAM <= self.ends[owner])
        return at[inside]

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """64-bit hashes of strings, as signed numbers."""
        digest, data = xxhash.xxh3_64_intdigest, self.data
        found = [digest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        return np.array(found, np.uint64).view(np.int64)

    def contexts(self) -> np.ndarray:
        return self.hashes(self.anchors - self.radius, self.anchors + self.radius + GRAM)

    def runs(self, shared: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """(owner, first, last, core, full) of the runs of windows whose inner anchors are all ``shared``.

        ``first`` and ``last`` are window starts within the text.
        """
        behind, ahead = self.radius, self.radius + GRAM
        edges = [self.starts, self.anchors - behind + 1, self.anchors + ahead - length]
        edge = np.concatenate(edges)
        owner = np.concatenate([np.arange(len(self.starts)), self.owner, self.owner])
        real = (edge >= self.starts[owner]) & (edge <= self.ends[owner] - length)
        first = np.unique(edge[real])
        if not len(first):
            return (np.empty(0, np.int64),) * 5
        owner = np.searchsorted(self.ends, first, side="right")
        last = np.minimum(np.append(first[1:], np.iinfo(np.int64).max) - 1, self.ends[owner] - length)
        low = np.searchsorted(self.anchors, first + behind)
        high = np.searchsorted(self.anchors, first + length - ahead, side="right") - 1
        bare = np.flatnonzero(high < low)
        unshared = np.concatenate(([0], np.cumsum(~shared)))
        live = np.flatnonzero((high >= low) & (unshared[np.maximum(high, low - 1) + 1] == unshared[low]))
        core = self.hashes(self.anchors[low[live]] - behind, self.anchors[high[live]] + ahead)
        full = self.hashes(first[live], last[live] + length)
        counts = last[bare] - first[bare] + 1
        single = np.repeat(first[bare] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        bare_owner = np.repeat(owner[bare], counts)
        two = self.windows(single, length)
        owner = np.concatenate([owner[live], bare_owner])
        return (
            owner,
            np.concatenate([first[live], single]) - self.starts[owner],
            np.concatenate([last[live], single]) - self.starts[owner],
            np.concatenate([core, two[:, 0]]),
            np.concatenate([full, two[:, 1]]),
        )

    def windows(self, starts: np.ndarray, length: int) -> np.ndarray:
        """128-bit hashes of windows, as two signed columns."""
        digest, data = xxhash.xxh3_128_digest, self.data
        found = b"".join([digest(data[a : a + length]) for a in starts.tolist()])
        return np.frombuffer(found, "<i8").reshape(-1, 2)


def _texts(part: pa.RecordBatch, radius: int) -> Texts:
    return Texts(part.column("_text").to_pylist(), radius)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, pc.binary_length(batch.column("_text")), SLICE_BYTES)


def _flat_ranges(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in the part, lo, hi) of a column of structs' lists."""
    lists = part.column(column)
    flat = lists.flatten()
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(part.num_rows), lengths)
    return row, *(flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("lo", "hi"))


def _anchor_rows(batches, radius: int):
    for part in _parts(batches):
        texts = _texts(part, radius)
        rows = part.column("_row").to_numpy()[texts.owner]
        at = texts.anchors - texts.starts[texts.owner]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(at.astype(np.int32)), pa.array(texts.contexts())], names=["_row", "at", "context"]
        )


def _run_rows(batches, radius: int, length: int):
    for part in _parts(batches):
        texts = _texts(part, radius)
        listed = part.column("shared")
        places = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = pc.list_value_length(listed).fill_null(0).to_numpy(zero_copy_only=False)
        shared = np.isin(texts.anchors, places + np.repeat(texts.starts, counts))
        owner, first, last, core, full = texts.runs(shared, length)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.column("_row").to_numpy()[owner]),
                pa.array(first.astype(np.int32)),
                pa.array(last.astype(np.int32)),
                pa.array(core),
                pa.array(full),
            ],
            names=["_row", "lo", "hi", "core", "full"],
        )


def _window_rows(batches, length: int):
    for part in _parts(batches):
        texts = Texts(part.column("_text").to_pylist(), 1)
        row, lo, hi = _flat_ranges(part, "ranges")
        counts = hi - lo + 1
        at = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        row = np.repeat(row, counts)
        two = texts.windows(at + texts.starts[row], length)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.column("_row").to_numpy()[row]), pa.array(at.astype(np.int32)), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())],
            names=["_row", "at", "h1", "h2"],
        )


def _cut(batches, length: int, names: list[str]):
    for part in _parts(batches):
        texts = part.column("_text").to_pylist()
        row, lo, hi = _flat_ranges(part, "ranges")
        starts = np.searchsorted(row, np.arange(part.num_rows + 1))
        kept, removed, spans = [], [], []
        for i, text in enumerate(texts):
            text = text or b""
            of = slice(starts[i], starts[i + 1])
            if of.start == of.stop:
                kept.append(text)
                removed.append(0)
                spans.append(0)
                continue
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, lo[of], 1)
            np.add.at(change, hi[of] + length, -1)
            covered = np.cumsum(change[:-1]) > 0
            kept.append(np.frombuffer(text, np.uint8)[~covered].tobytes())
            removed.append(int(covered.sum()))
            spans.append(int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()))
        yield pa.RecordBatch.from_arrays(
            [
                *(part.column(n) for n in names),
                pa.array(kept, pa.binary()),
                pa.array([len(t or b"") for t in texts], pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
            ],
            names=[*names, "kept", "n_bytes", "n_removed", "n_spans"],
        )


@sets_aside("_text", "_row", "ranges", "shared")
def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with kept (bytes), n_bytes, n_removed and n_spans.

    Texts are taken as UTF-8 bytes, null as empty; strings never cross texts, and
    all are judged on the input. Repeated rows are texts of their own, so all
    copies lose what they share. What is kept may begin or end inside a code
    point. Columns named like a result are replaced, others passed on; no row is
    dropped; an empty table stays empty.

    Lists are only gathered by row, so none is longer than a text. The texts are
    stored once, bucketed by a row number; the three joins that bring places back
    to them move the places alone.
    """
    if length < 2 * GRAM + 2:
        raise ValueError(f"length must be {2 * GRAM + 2} or more")
    results = ["kept", "n_bytes", "n_removed", "n_spans"]
    own = other_columns(docs, results)
    radius = radius_of(length)
    store = Store(docs.sparkSession, "repeats")
    numbered = docs.select(*own, F.col("text").cast("binary").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    numbered = numbered.drop("text") if "text" in own else numbered
    texts = store.keep_bucketed(numbered, "_row")
    store.release()
    own = [c for c in own if c != "text"]

    anchors = texts.select("_row", "_text").mapInArrow(partial(_anchor_rows, radius=radius), "_row bigint, at int, context bigint")
    anchors = store.keep(anchors)
    met = store.keep(anchors.groupBy("context").agg(F.count("*").alias("n")).filter("n > 1").select("context"))
    shared = anchors.join(met, "context").groupBy("_row").agg(F.collect_list("at").alias("shared"))
    runs = (
        texts.select("_row", "_text")
        .join(shared, "_row", "left")
        .mapInArrow(partial(_run_rows, radius=radius, length=length), "_row bigint, lo int, hi int, core bigint, full bigint")
    )
    runs = store.keep(runs)
    store.drop(anchors)
    store.release()

    groups = runs.groupBy("core", "full").agg(F.count("*").alias("n"), F.min(F.struct("_row", "lo")).alias("stands"))
    groups = store.keep(groups)
    cores = store.keep(
        groups.groupBy("core").agg(F.sum("n").alias("total"), F.min("n").alias("least")).filter("total > 1 AND least = 1").select("core", F.lit(True).alias("open"))
    )
    judged = groups.join(cores, "core", "left").filter("n > 1 OR open")
    judged = store.keep(judged.select("core", "full", "n", "stands", F.coalesce("open", F.lit(False)).alias("open")))
    marked = store.keep(
        runs.join(judged, ["core", "full"]).select(
            "_row",
            "lo",
            "hi",
            (F.col("n") > 1).alias("whole"),
            (F.col("open") & ((F.col("n") == 1) | ((F.col("stands._row") == F.col("_row")) & (F.col("stands.lo") == F.col("lo"))))).alias("look"),
        )
    )
    store.drop(runs)
    store.release()

    def by_row(places: DataFrame) -> DataFrame:
        return places.groupBy("_row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    windows = (
        texts.select("_row", "_text")
        .join(by_row(marked.filter("look")), "_row")
        .mapInArrow(partial(_window_rows, length=length), "_row bigint, at int, h1 bigint, h2 bigint")
    )
    windows = store.keep(windows)
    again = store.keep(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"))
    single = windows.join(again, ["h1", "h2"]).select("_row", F.col("at").alias("lo"), F.col("at").alias("hi"))
    spans = store.keep(by_row(marked.filter("whole").select("_row", "lo", "hi").unionByName(single)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name in own)
    cut = texts.join(spans, "_row", "left").mapInArrow(
        partial(_cut, length=length, names=own), f"{kinds + ', ' if kinds else ''}kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"
    )
    return cut
