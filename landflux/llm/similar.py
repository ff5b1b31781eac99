"""Near copies by the Jaccard similarity of word shingles.

Two texts are linked if their sets of 5-word shingles have a Jaccard similarity
of 0.8 or more. Candidates come in two ways. SimHash prints of the sets go
through op1's index of bytes and its count of differing bits; this finds the
closest pairs, but at 0.8 about ten of 64 bits differ, more than the index can
bridge. So pairs also meet that share a band of MinHash values: with 25 bands of
4 values a pair at 0.8 meets in none with a chance of 2 in a million, a closer
pair with less. Texts that meet, directly or through others, form a candidate
group; within a group the sets themselves are compared until its groups of
linked texts are known, so neither way links what is under 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landflux.llm import simhash
from landflux.llm.components import components
from landflux.llm.store import Store

WORDS = 5  # of a shingle
SIMILAR = (4, 5)  # least Jaccard similarity, as a fraction
BANDS, BAND_ROWS = 25, 4
SEED = 42
SLOTS = 1 << 20  # most rows of the broadcast set that texts are told apart by before any is shuffled
BLOCK = 1 << 10  # shingles whose values are computed at once
FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=(BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = np.random.default_rng(SEED + 1).integers(1 << 63, size=(BANDS * BAND_ROWS, 1), dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """One signed number for each band of MinHash values of a set of shingles."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[at : at + BLOCK] * FACTORS + SHIFTS).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), n)) for n, row in enumerate(rows)]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _node(found: np.ndarray) -> int:
    """The name of a set of shingles; equal sets are one node."""
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, prints, keys = [], [], []
        for text in batch.column("text"):
            found = shingles(text.as_py())
            nodes.append(_node(found))
            prints.append(simhash.majority(found))
            keys.append(bands(found))
        sketches = [pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), *sketches],
            names=["doc_id", "text_key", "node", "print", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingles(text.as_py()).tobytes() for text in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("candidates"), batch.column("node"), sets], names=["candidates", "node", "shingles"]
        )


def linked_groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the position of the first set it is linked to, directly or through others.

    A set is compared with those no group has reached yet, so a large group that
    is close to its first member takes little more than one pass.
    """
    root = np.full(len(sets), -1)
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    first = np.concatenate(([0], np.cumsum(sizes)))
    own = lambda k: ids[first[k] : first[k + 1]]
    mark = np.zeros(len(ids), bool)
    left, flat = np.arange(len(sets)), ids
    over, under = SIMILAR
    while len(left):
        start = int(left[0])
        root[start] = start
        flat, left = flat[sizes[start] :], left[1:]
        reached = [start]
        while reached and len(left):
            at = reached.pop()
            mark[own(at)] = True
            common = np.add.reduceat(mark[flat], np.concatenate(([0], np.cumsum(sizes[left])[:-1])), dtype=np.int64)
            mark[own(at)] = False
            near = common * under >= over * (sizes[left] + sizes[at] - common)
            if near.any():
                root[left[near]] = start
                reached.extend(left[near].tolist())
                flat = flat[np.repeat(~near, sizes[left])]
                left = left[~near]
    return root


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of rows sorted by candidate group and node; a group may span batches."""
    group, nodes, sets = None, [], []

    def found() -> pa.RecordBatch:
        root = linked_groups(sets)
        named = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(named), pa.array(named[root])], names=["node", "component"])

    for batch in batches:
        columns = zip(batch.column("candidates").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles"), strict=True)
        for candidates, node, packed in columns:
            if candidates != group:
                if nodes:
                    yield found()
                group, nodes, sets = candidates, [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                sets.append(np.frombuffer(packed.as_py(), np.uint64))
    if nodes:
        yield found()


def near_prints(nodes: DataFrame, store: Store) -> DataFrame:
    """(a, b) nodes whose SimHash prints differ in ``simhash.BITS`` bits at most, enough to connect every group.

    ``nodes`` needs node and print, each node once.
    """
    firsts = store.keep(nodes.groupBy(F.col("print").alias("fp")).agg(F.min("node").alias("first")))
    equal = nodes.join(firsts, F.col("print") == F.col("fp")).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = simhash.links(firsts.select("fp")).withColumnsRenamed({"a": "fp", "b": "other"})
    found = found.join(firsts.withColumnRenamed("first", "a"), "fp").drop("fp").withColumnRenamed("other", "fp")
    return equal.unionByName(found.join(firsts.withColumnRenamed("first", "b"), "fp").select("a", "b"))


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(a, b) nodes that share a band of MinHash values, enough to connect every group."""
    entries = nodes.select("node", F.explode("bands").alias("key"))
    firsts = entries.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return entries.join(firsts, "key").filter("node <> b").select(F.col("node").alias("a"), "b")


def similar_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``, component_id being the smallest doc_id linked to it.

    ``docs`` needs doc_id and text; other columns are ignored. A null or wordless
    text is one empty shingle. Rows with the same text or doc_id each give a row. A
    null doc_id takes part in linking but never names a component; if no row of a
    component has an id, component_id is null. An empty table gives an empty table.

    Rows are reduced to distinct sets of shingles before anything is compared.
    """
    store = Store(docs.sparkSession, "similar")
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    plain = plain.withColumn("text_key", F.xxhash64("text"))
    kinds = "doc_id bigint, text_key bigint, node bigint, print bigint, bands array<bigint>"
    rows = store.keep(plain.mapInArrow(_sketched, kinds))
    # print and bands follow from the node
    kept = [F.min(c).alias(c) for c in ("text_key", "print", "bands")]
    nodes = store.keep(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), *kept))
    meets = near_prints(nodes, store).unionByName(shared_bands(nodes)).distinct()
    candidates = store.keep(components(store.keep(meets), store).withColumnRenamed("component", "candidates"))
    wanted = store.keep(nodes.select("node", "text_key").join(candidates, "node"))
    store.release()
    # slots of the wanted keys, never more than SLOTS: texts under no such slot need not move to meet the keys
    slot = F.col("text_key").bitwiseAND(SLOTS - 1).cast("int").alias("slot")
    slots = F.broadcast(wanted.select(slot).distinct())
    near = plain.select("text", "text_key", slot).join(slots, "slot", "left_semi")
    texts = near.join(wanted, "text_key").select("candidates", "node", "text")
    sets = texts.mapInArrow(_sets, "candidates bigint, node bigint, shingles binary")
    sets = sets.repartition("candidates").sortWithinPartitions("candidates", "node")
    linked = store.keep(sets.mapInArrow(_linked, "node bigint, component bigint"))
    store.release()
    named = store.keep(
        nodes.select("node", "first_id").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = store.keep(named.join(store.keep(smallest), "component").select("node", "component_id"))
    return rows.join(labels, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id.

    A doc_id stands for one document: rows that repeat it stay or go together.
    Rows without an id stay.
    """
    copies = similar_copies(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)
