from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).parent))
from plain import docs_of, smallest_reachable  # noqa: E402

import corpus_pipeline  # noqa: E402

from landflux.llm import simhash, similar  # noqa: E402


def plain_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]


def plain_links(sets):
    return [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    pairs = [(rows[a].doc_id, rows[b].doc_id) for a, b in plain_links(plain_sets([r.text for r in rows]))]
    want = smallest_reachable([r.doc_id for r in rows], pairs)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(want.values())
    assert not any(a in kept and b in kept for a, b in pairs) and len(pairs) > 100
    assert {r.doc_id: r.component_id for r in similar.similar_copies(docs).collect()} == want


def test_short_texts_with_changed_words(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(64)]
    changed = [[*base[:k], "other", *base[k + 1 :]] for k in (0, 1, 2, 30, 63)]
    texts = [" ".join(w) for w in (base, *changed)] + [None, "", "One two", "one  TWO", "one two three"]
    want = smallest_reachable(range(len(texts)), plain_links(plain_sets(texts)))
    got = similar.similar_copies(docs_of(spark, texts, node="clash", bands="clash", text_key="clash")).collect()
    assert {r.doc_id: r.component_id for r in got} == want and want[4] == 0 and want[7] == 6 and want[9] == 8
    assert similar.similar_copies(docs_of(spark, [])).collect() == []


def test_groups_within_candidates_equal_all_pairs():
    rng = random.Random(8)
    sets = []
    for _ in range(12):
        core = [rng.randrange(1 << 60) for _ in range(40)]
        for _ in range(15):
            sets.append({c if rng.random() > 0.08 else rng.randrange(1 << 60) for c in core})
    rng.shuffle(sets)
    got = similar.linked_groups([np.array(sorted(s), np.uint64) for s in sets])
    want = smallest_reachable(range(len(sets)), plain_links(sets))
    assert {i: int(r) for i, r in enumerate(got)} == want


def test_simhash_prints_are_a_step_beside_the_bands(spark, monkeypatch):
    """Without bands the prints alone find close pairs, and what they find is still compared as sets."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    short = "a b c d e f".split()
    texts = [" ".join(w) for w in (base, [*base[:200], "other", *base[201:]], base[:240], short, [*short, *short])] + [None, ""]
    sets = plain_sets(texts)
    want = smallest_reachable(range(len(texts)), plain_links(sets))
    prints = [simhash.majority(similar.shingles((t or "").encode())) for t in texts]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= simhash.BITS
    none = spark.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(similar, "shared_bands", lambda nodes: none)
    got = {r.doc_id: r.component_id for r in similar.similar_copies(docs_of(spark, texts)).collect()}
    assert got == want and got[1] == 0 and got[2] == 2 and got[6] == 5


def test_prints_that_meet_do_not_link_by_themselves(spark, monkeypatch):
    """Any candidates, here all texts at once, are told apart by their sets."""
    texts = ["one two three four five six", "one two three four five six", "one two three four five seven", "other words"]
    nodes = lambda given, store: given.selectExpr("node as a", f"{min(map(similar._node, map(similar.shingles, map(str.encode, texts))))}L as b")
    monkeypatch.setattr(similar, "near_prints", nodes)
    got = {r.doc_id: r.component_id for r in similar.similar_copies(docs_of(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
