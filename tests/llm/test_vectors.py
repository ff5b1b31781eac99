from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from plain import smallest_reachable  # noqa: E402

from landflux.llm import vectors  # noqa: E402

VECTOR = "vec_id bigint, embedding array<double>, node string, label int"


def check(spark, rows, least=0.9):
    frame = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], VECTOR)
    got = sorted(vectors.near_vectors(frame, least).collect(), key=lambda r: r.vec_id)
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            w = np.array(v) / np.abs(v).max()
            good[i] = w / np.sqrt(w @ w)
    pairs = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least]
    links = {i: 0 for i, _ in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    component = smallest_reachable(links, pairs)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        i: (links[i], component[i], component[i] == i) for i in links
    }
    assert len(got) == len(rows)


@pytest.mark.parametrize("block, cell", [(4096, 8192), (16, 40), (7, 25)])
def test_clusters_over_many_cells(spark, monkeypatch, block, cell):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELL", cell)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=16)
        for spread in rng.uniform(0.05, 0.6, size=rng.integers(1, 30)):
            rows.append(centre + spread * rng.normal(size=16))
    rows += list(rng.normal(size=(60, 16)))
    rng.shuffle(rows)
    check(spark, [(i, [float(x) for x in v]) for i, v in enumerate(rows)])


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(5, one), (3, one), (4, [2.0, 4.0, 6.0]), (6, [1e-300, 2e-300, 3e-300]), (7, [1e300, 2e300, 3e300]), (8, None), (9, []),
            (10, [0.0, 0.0, 0.0]), (11, [None, 1.0, 2.0]), (12, [float("nan"), 1.0, 1.0]), (13, [float("inf"), 1.0, 1.0]),
            (14, [1.0, 2.0]), (15, [2.0, 4.0]), (16, [-1.0, -2.0, -3.0]), (17, [-0.0, 0.0, 1.0]), (18, [0.0, 0.0, 1.0])]
    check(spark, rows)


def test_empty_table_and_missing_ids(spark):
    assert vectors.near_vectors(spark.createDataFrame([], VECTOR)).collect() == []
    frame = spark.createDataFrame([(None, [1.0], "", 0), (4, [1.0], "", 0), (None, None, "", 0)], VECTOR)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, False)], key=str)


def test_bounds_lose_no_partner(spark):
    """The cells a vector is sent to hold every partner, whatever the pivots."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 6))
    points = np.concatenate([base, base + 0.25 * rng.normal(size=base.shape)])
    points /= np.linalg.norm(points, axis=1)[:, None]
    pivots = vectors.fit_pivots(points[:200], 12)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in points], pa.binary())], names=["unit"])
    reach = float(np.sqrt(0.2))
    home = np.array(next(vectors._cells([batch], pivots, None, reach)).column("home"))
    distance = np.array(next(vectors._cells([batch], pivots, None, reach)).column("distance"))
    radii = np.array([distance[home == k].max(initial=0) for k in range(len(pivots))])
    also = next(vectors._cells([batch], pivots, radii, reach)).column("also").to_pylist()
    near = np.argwhere(np.triu(points @ points.T >= 0.9, 1))
    for a, b in near:
        low, high = (a, b) if home[a] <= home[b] else (b, a)
        assert home[a] == home[b] or home[low] in also[high]
    assert sum(map(len, also)) < len(points) * (len(pivots) - 1) / 2
