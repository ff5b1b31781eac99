"""Near copies by SimHash fingerprints and an index of their bytes.

Two fingerprints within three differing bits agree on five of their eight bytes
at least. The index lists, for eight choices of three byte positions, the
fingerprints by the bytes at those positions: of any five positions, three lie
in one half of the fingerprint, so a pair that agrees on five bytes meets in the
index. Pairs that meet are verified by counting differing bits; the count of
shared bytes, which the bits imply, never decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landflux.llm.components import components
from landflux.llm.store import Store

BITS = 3  # differing bits of linked fingerprints
LEAST_SHARED = 8 - BITS
HALVES = [[c for c in combinations(half, 3)] for half in (range(4), range(4, 8))]
TRIPLES = HALVES[0] + HALVES[1]
LONG_LIST = 512  # index lists over this length are split by two more bytes
LONG_RUN = 1 << 13  # longer runs look every neighbour up instead of comparing pairs
SEED = 42
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """SimHash of the word 3-shingles of a text, as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < 3:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:-2], ends[2:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return majority(hashes)


def majority(hashes: Sequence[int]) -> int:
    """The bits set in over half of some 64-bit hashes, as a signed number."""
    tally = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.array(hashes[at : at + BLOCK], dtype=">u8")
        tally += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(tally * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); other columns are not read."""
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _byte(position: int):
    return F.shiftrightunsigned("fp", 56 - 8 * position).bitwiseAND(F.lit(255))


def _packed(positions, number: int):
    """The bytes at some positions as one number, apart for each choice of positions."""
    key = F.lit(number).cast("bigint")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def index_entries(prints: DataFrame) -> DataFrame:
    """(key, fp): the positional index without lists of one entry, long lists split.

    A list over ``LONG_LIST`` entries is listed again by each pair of the five
    positions its key leaves open; a linked pair agrees on two of them. Such a
    list fixes five bytes, so it holds 2 to the power 24 fingerprints at most,
    whatever the size of a group of near copies.
    """
    rows = prints.select("fp", F.explode(F.array(*[_packed(t, n) for n, t in enumerate(TRIPLES)])).alias("key"))
    lengths = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(lengths, "key")
    short = rows.filter(F.col("n") <= LONG_LIST).select("key", "fp")
    split = F.lit(None).cast("array<bigint>")
    number = len(TRIPLES)
    for n, triple in enumerate(TRIPLES):
        keys = []
        for pair in combinations([p for p in range(8) if p not in triple], 2):
            keys.append(_packed((*triple, *pair), number))
            number += 1
        split = F.when(F.shiftrightunsigned("key", 24) == n, F.array(*keys)).otherwise(split)
    long = rows.filter(F.col("n") > LONG_LIST).select(F.explode(split).alias("key"), "fp")
    return short.unionByName(long)


def _linked_pairs(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs within runs of one key, spanning each run's groups.

    The pairs are compared at growing distance within all runs at once; after
    each distance, pairs already connected are thrown away, so that what is held
    grows with the rows.
    """
    root = np.arange(len(keys))
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    for at, length in zip(starts[lengths > LONG_RUN], lengths[lengths > LONG_RUN], strict=True):
        _look_up(root, int(at), prints[at : at + length])
    left = np.flatnonzero(np.repeat(lengths <= LONG_RUN, lengths))
    for step in range(1, len(keys)):
        left = left[left + step < len(keys)]
        left = left[keys[left] == keys[left + step]]
        if not len(left):
            break
        differing = prints[left] ^ prints[left + step]
        shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        likely = shared >= LEAST_SHARED
        at = left[likely]
        at = at[np.bitwise_count(differing[likely].view(np.uint64)) <= BITS]
        _unite(root, at, at + step)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return moved, root[moved]


def _look_up(root: np.ndarray, at: int, run: np.ndarray) -> None:
    """Connect a long run (sorted, distinct, at position ``at``) by its fingerprints' neighbours.

    Only bits in which the run varies can differ: those of three bytes in a
    split list, so at most 2,324 neighbours each, whatever the run's length.
    """
    varying = int(np.bitwise_or.reduce(run ^ run[0])) & (1 << 64) - 1
    open_bits = [1 << b for b in range(64) if varying >> b & 1]
    for n in range(1, BITS + 1):
        for chosen in combinations(open_bits, n):
            mask = np.array([sum(chosen)], np.uint64).view(np.int64)[0]
            wanted = run ^ mask
            place = np.minimum(np.searchsorted(run, wanted), len(run) - 1)
            hit = np.flatnonzero(run[place] == wanted)
            _unite(root, at + hit, at + place[hit])


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Connect positions a and b; afterwards root points to each group's first position."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, fp) that come sorted by key; a list may span batches."""
    held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def found(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = _linked_pairs(keys, prints)
        return pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_key, batch.column("key").to_numpy(zero_copy_only=False)])
        prints = np.concatenate([held_fp, batch.column("fp").to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield found(keys[:last], prints[:last])
        held_key, held_fp = keys[last:], prints[last:]
    if len(held_key):
        yield found(held_key, held_fp)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) fingerprints within ``BITS`` bits, enough of them to connect every group."""
    listed = index_entries(prints).repartition("key").sortWithinPartitions("key", "fp")
    return listed.mapInArrow(_links, "a bigint, b bigint")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their
    names. A null or wordless text has fingerprint zero and links like any
    other. Rows with the same text or doc_id each give a row. A null doc_id
    takes part in linking but never names a component; if no row of a component
    has an id, component_id is null. An empty table gives an empty table.

    Rows are reduced to distinct fingerprints before anything is compared, so a
    group of copies is one entry however large it is.
    """
    store = Store(docs.sparkSession, "simhash")
    rows = store.keep(fingerprints(docs))
    prints = store.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    connected = store.keep(components(store.keep(links(prints)), store))
    known = prints.join(connected.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    named = store.keep(known)
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = store.keep(named.join(store.keep(smallest), "component").select("fp", "component_id"))
    return rows.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
