from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from plain import docs_of, smallest_reachable  # noqa: E402

from landflux.llm import simhash  # noqa: E402
from landflux.llm.components import components  # noqa: E402
from landflux.llm.store import Store  # noqa: E402


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    pairs = [
        (a, b)
        for i, a in enumerate(ids)
        for j, b in enumerate(ids[:i])
        if (prints[i] ^ prints[j]).bit_count() <= 3
    ]
    return smallest_reachable(ids, pairs)


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = plain_components([r.doc_id for r in rows], prints)
    got = simhash.near_copies(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {
        r.doc_id: f"{p:016x}" for r, p in zip(rows, prints, strict=True)
    }


def test_edge_texts(spark):
    texts = [None, "", " \n\t", "one", "One", "two words", "a b c", "A  b\tc", "x " * 50_000, "é\x85b c d", None]
    got = {r.doc_id: r for r in simhash.near_copies(docs_of(spark, texts, fp="f", key="k", component="c")).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {got[i].component_id for i in (0, 1, 2, 10)} == {0}
    assert got[4].component_id == 3 and got[7].component_id == 6


def test_empty_table_and_missing_ids(spark):
    assert simhash.near_copies(docs_of(spark, [])).collect() == []
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "lone text here now")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(rows).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None)], key=str)


@pytest.mark.parametrize("long_list, long_run", [(512, 1 << 13), (8, 1 << 13), (8, 4)])
def test_links_of_dense_groups(spark, monkeypatch, long_list, long_run):
    """Groups of prints a few bits apart, with lists split and looked up, against all pairs."""
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(40, 64)
            prints.add(p - (1 << 64) if p >> 63 else p)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    entries = simhash.index_entries(spark.createDataFrame([(p,) for p in prints], "fp bigint")).toPandas()
    entries = entries.sort_values(["key", "fp"])
    monkeypatch.setattr(simhash, "LONG_RUN", long_run)
    keys, values = entries.key.to_numpy(), entries.fp.to_numpy()
    a, b = simhash._linked_pairs(keys, values)
    got = smallest_reachable(prints, list(zip(values[a].tolist(), values[b].tolist(), strict=True)))
    want = smallest_reachable(
        prints, [(x, y) for x in prints for y in prints if x < y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 3]
    )
    assert got == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)]
    edges += [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)]
    frame = spark.createDataFrame(edges + edges[:5], "a bigint, b bigint")
    got = {r.node: r.component for r in components(frame, Store(spark, "t")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == smallest_reachable(nodes, edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Store(spark, "t")).collect() == []
