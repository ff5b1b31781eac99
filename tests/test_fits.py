"""Curves fitted by sums against fits on the rows themselves."""

from __future__ import annotations

import random

import numpy as np
import pytest
from plan_rows import rows_made
from pyspark.sql import functions as F

from landflux.functions import fits

POINT = "g string, x double, y double"


def fit(df, **options):
    return fits.fit_rows(df, ["g"], "y", fits.saturating("x"), {"a": F.max("y"), "b": F.lit(0.5)}, **options)


def by_rows(x, y, a, b):
    """Gauss-Newton steps with halving, on all rows at once."""
    for _ in range(500):
        left = np.exp(-b * x)
        r = y - a * (1 - left)
        jacobian = np.stack([1 - left, a * x * left], axis=1)
        step = np.linalg.lstsq(jacobian, r, rcond=None)[0]
        for _ in range(40):
            new = np.array([a, b]) + step
            if np.sum((y - new[0] * (1 - np.exp(-new[1] * x))) ** 2) <= np.sum(r**2):
                break
            step = step / 2
        a, b = new
    return a, b


def points(rng, g, a, b, n, noise):
    return [(g, x, a * (1 - np.exp(-b * x)).item() + rng.gauss(0, noise)) for x in (rng.uniform(0, 40) for _ in range(n))]


def test_equals_a_fit_on_rows(spark):
    rng = random.Random(3)
    rows = points(rng, "hot", 120.0, 0.08, 4000, 5.0) + points(rng, "b", 40.0, 0.3, 300, 2.0) + points(rng, None, 7.0, 0.02, 500, 0.1)
    got = {r.g: r for r in fit(spark.createDataFrame(rows, POINT)).collect()}
    for g, true in (("hot", (120.0, 0.08)), ("b", (40.0, 0.3)), (None, (7.0, 0.02))):
        x, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        want = by_rows(x, y, y.max(), 0.1)
        assert got[g].converged and got[g].n == len(x)
        assert (got[g].a, got[g].b) == pytest.approx(want, rel=1e-5)
        assert (got[g].a, got[g].b) == pytest.approx(true, rel=0.1)
        assert got[g].rmse == pytest.approx(np.sqrt(np.mean((y - want[0] * (1 - np.exp(-want[1] * x))) ** 2)), rel=1e-6)


def test_a_hot_group_is_added_up_in_many_tasks(spark):
    """Each task sends one row of sums a group, however many rows it has."""
    df = spark.range(0, 20_000, 1, 8).select(F.lit("g").alias("g"), (F.col("id") % 40).cast("double").alias("x"))
    df = df.withColumn("y", 50 * (1 - F.exp(-0.1 * F.col("x"))))
    trial = spark.createDataFrame([("g", [45.0, 0.2])], "g string, _trial array<double>")
    sums = fits._sums(df, ["g"], "y", fits.saturating("x"), ["a", "b"], trial)
    assert rows_made(sums, "HashAggregate") + rows_made(sums, "ObjectHashAggregate") <= 9
    (row,) = fit(df).collect()
    assert (row.a, row.b, row.n) == pytest.approx((50, 0.1, 20_000), rel=1e-6)


def test_groups_that_can_not_be_fitted(spark):
    rows = [("null", 1.0, None), ("null", None, 2.0), ("one", 3.0, 6.0), ("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("empty", None, None)]
    got = {r.g: r for r in fit(spark.createDataFrame(rows, POINT)).collect()}
    assert set(got) == {"null", "one", "flat", "empty"}
    assert got["null"].a is None and got["empty"].a is None and not got["null"].converged
    assert got["one"].rmse == pytest.approx(0, abs=1e-6) and got["one"].n == 1
    assert got["flat"].rmse == pytest.approx(0, abs=1e-3)
    assert fit(spark.createDataFrame([], POINT)).count() == 0


def test_too_few_rounds_are_told(spark):
    rows = points(random.Random(1), "g", 120.0, 0.02, 200, 1.0)
    (row,) = fit(spark.createDataFrame(rows, POINT), rounds=2).collect()
    assert not row.converged and row.a is not None
