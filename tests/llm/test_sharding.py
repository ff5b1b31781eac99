from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from landflux.llm import sharding
from landflux.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def plain(numbered, shards, buckets, seed):
    """(row number, shard, slot) by plain Python: deal, shuffle each bucket, lay out, cut."""
    dealt = {}
    for row in sorted(numbered):
        first = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        key = signed(xxhash.xxh64_intdigest(struct.pack("<q", row), first))
        dealt.setdefault(key % buckets, []).append(row)
    line = []
    for bucket in sorted(dealt):
        rows = list(dealt[bucket])
        np.random.default_rng([seed, bucket]).shuffle(rows)
        line += rows
    out, at = [], 0
    for shard in range(shards):
        n = len(line) // shards + (shard < len(line) % shards)
        out += [(row, shard, slot) for slot, row in enumerate(line[at : at + n])]
        at += n
    return out


def law_holds(rows, shards):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


@pytest.mark.parametrize("shards, bucket_bytes", [(8, 1 << 20), (3, 200), (8, 20)])
def test_equals_the_plain_form(spark, shards, bucket_bytes):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)], DOC).coalesce(1)
    rows = sharding.shuffle_shards(docs, shards=shards, bucket_bytes=bucket_bytes).collect()
    total = sum(i % 50 + 1 for i in range(500))
    buckets = max(4 * shards, -(-total // bucket_bytes))
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted(plain(range(500), shards, buckets, 42))
    law_holds(rows, shards)


def test_whole_table(spark):
    rows = QUERIES["op11_sharding"](spark, SMALL).collect()
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(want)
    for r in rows:
        data = want[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    law_holds(rows, 8)


def test_reruns_agree_and_seeds_differ(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(300)], DOC)
    shown = lambda **k: sorted(map(tuple, sharding.shuffle_shards(docs, **k).collect()))
    assert shown() == shown() and shown() != shown(seed=7)


def test_hot_group_is_dealt_over_all_shards(spark):
    """Two thirds of the rows are one and the same row."""
    docs = spark.createDataFrame([(7, "same")] * 4000 + [(i, str(i)) for i in range(2000)], DOC)
    rows = sharding.shuffle_shards(docs).collect()
    law_holds(rows, 8)
    same = Counter(r.shard for r in rows if r.text == "same")
    assert all(400 < same[k] < 600 for k in range(8))
    # neighbours in a shard are not neighbours in the input
    ids = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.text != "same"]
    assert sum(abs(a - b) == 1 for a, b in zip(ids, ids[1:], strict=False)) < 20


def test_nulls_long_texts_clashes_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "é" * 300_000), (3, "a")], DOC)
    odd = docs.withColumns({n: F.lit(f"given {n}") for n in ("_row", "_Bucket", "SIZE", "slot", "law")})
    out = sharding.write_shards(odd, str(tmp_path / "a"), bucket_bytes=1000)
    rows = out.collect()
    law_holds(rows, 8)
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 2, 600_001]
    assert {r["_row"] for r in rows} == {"given _row"} and {r["_Bucket"] for r in rows} == {"given _Bucket"}
    assert {r["law"] for r in rows} == {"given law"}
    empty = sharding.write_shards(docs.filter("false"), str(tmp_path / "b"))
    assert empty.count() == 0 and set(out.columns) >= {"doc_id", "text", "size", "shard", "slot"}
