from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from landflux.llm import mixing  # noqa: E402

DOC = "doc_id bigint, text string, source string, size string"


def plain_targets(sizes):
    """Targets by pouring the excess again until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    return target


def mixed(frame):
    return [r.asDict() for r in mixing.mix(frame).collect()]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(6)
    sources = ["b", "a", "ä", None, "hot", "tiny", "c d"]
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else rng.choice(sources)
        text = None if i % 97 == 0 else " \n".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, source, "clash"))
    rows += [(600, "one two three", "tiny", "clash")] * 2 + [(None, "no id", "a", "clash")]
    return spark.createDataFrame(rows, DOC)


def test_targets_and_budgets(frame):
    rows = mixed(frame)
    assert len(rows) == 603
    sizes, taken = {}, {}
    for r in rows:
        size = len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
        assert r["size"] == size and 0 <= r["taken"] <= 3 * size
        sizes[r["source"]] = sizes.get(r["source"], 0) + size
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s, t in taken.items():
        assert abs(t - want[s]) <= 40


def test_keys_order_whole_epochs_first(frame):
    rows = mixed(frame)
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source and r["size"]]
        epochs = {r["taken"] // r["size"] for r in mine}
        assert max(epochs) - min(epochs) <= 1 and min(epochs) == mine[0]["epochs"]


def test_reruns_and_partitions_agree(frame):
    key = lambda rows: sorted((str(r["doc_id"]), r["text"] or "", r["taken"]) for r in rows)
    assert key(mixed(frame)) == key(mixed(frame.repartition(7)))


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "word " * 20 if i % 2 else "%%% " * 20, "s", "") for i in range(4000)] + [(9999, "w " * 40_000, "t", "")]
    out = mixed(spark.createDataFrame(rows, DOC))
    share = [sum(r["sampled"] for r in out if r["source"] == "s" and r["doc_id"] % 2 == k) / 2000 for k in (0, 1)]
    assert share[1] > share[0] + 0.1


def test_empty_tables(spark):
    assert mixed(spark.createDataFrame([], DOC)) == []
    lone = mixed(spark.createDataFrame([(1, None, None, ""), (2, "", None, "")], DOC))
    assert [r["taken"] for r in lone] == [0, 0] and lone[0]["target"] == 0


def plain_mix(rows, targets_of):
    """Words taken of each row, by one sorted pass over each source."""
    order = sorted(rows, key=lambda r: (r["key"], r["doc_id"], r["size"]))
    taken, upto = {}, {}
    for r in order:
        size, target = r["source_size"], targets_of[r["source"]]
        epochs = min(3, int(target // size)) if size else 0
        budget, before = target - epochs * size, upto.get(r["source"], 0)
        picked = r["size"] > 0 and before + r["size"] / 2 <= budget
        upto[r["source"]] = before + r["size"]
        taken[r["doc_id"]] = (epochs + picked) * r["size"]
    return taken


def test_equals_one_sorted_pass(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(0, 30) + "%" * rng.randint(0, 40), rng.choice("aabbbbc"), "") for i in range(900)]
    measured = mixing.measure(spark.createDataFrame(rows, DOC).drop("size"))
    keys = {r.doc_id: r._key for r in measured.collect()}
    out = [r.asDict() | {"key": keys[r.doc_id]} for r in mixing.take(measured).collect()]
    targets_of = {r["source"]: r["target"] for r in out}
    assert {r["doc_id"]: r["taken"] for r in out} == plain_mix(out, targets_of)
    assert all(any(r["sampled"] != first["sampled"] for r in out if r["source"] == first["source"]) for first in out if first["target"] % first["source_size"])


def test_a_source_of_one_repeated_row_meets_its_target(spark):
    """Equal keys: as many of the copies are taken as the budget holds."""
    rows = [(7, "same words here", "a", "")] * 3000 + [(i, "one two three four", "b", "") for i in range(1000)]
    out = mixed(spark.createDataFrame(rows, DOC))
    for source in "ab":
        mine = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 4


def test_texts_stay_where_they_are(spark, frame):
    plan = mixing.mix(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Relation") <= 4
