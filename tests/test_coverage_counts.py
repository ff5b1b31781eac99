"""Units and providers seen in years and spans: nulls, gaps, and what one task holds."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from test_plan_shapes import plan_of

from landflux.operators import report

OBS = "unit_id bigint, obs_date date, provider_id bigint"


@pytest.fixture
def rows():
    rng = random.Random(5)
    years = [None, 1999, 2000, 2001, 2003]
    made = [(rng.choice([None, *range(30)]), rng.choice(years), rng.choice([None, 7, 8, 9])) for _ in range(150)]
    made.append((None, 2005, None))
    return [(u, y and dt.date(y, rng.randrange(1, 13), 1), p) for u, y, p in made]


def counts(rows, inside):
    held = [(u, p) for u, day, p in rows if inside(day and day.year)]
    return len({u for u, _ in held} - {None}), len({p for _, p in held} - {None})


def test_years_with_nulls(spark, rows):
    got = {r.year: r for r in report.coverage(spark.createDataFrame(rows, OBS)).collect()}
    assert set(got) == {day and day.year for _, day, _ in rows}
    for year, r in got.items():
        assert (r.n_units, r.n_providers) == counts(rows, lambda y, year=year: y == year)
        assert abs(r.approx_units - r.n_units) <= 3 * report.APPROX_ERROR * r.n_units


def test_no_sketch_beside_distinct_rows(spark, rows):
    """Counting several distinct columns beside a sketch gives every distinct row a sketch of its own."""
    plan = plan_of(report.coverage(spark.createDataFrame(rows, OBS)))
    assert "approx_count_distinct" in plan and "Expand" not in plan


def test_spans_with_nulls_and_gaps(spark, rows):
    asked = [(a, b) for a in range(1998, 2007) for b in range(a, 2007)]
    spans = spark.createDataFrame([*asked, asked[0]], "first_year int, last_year int")
    found = report.counts_of_spans(spark.createDataFrame(rows, OBS), spans).collect()
    got = {(r.first_year, r.last_year): (r.n_units, r.n_providers) for r in found}
    seen = {day.year for _, day, _ in rows if day}
    want = {(a, b): counts(rows, lambda y, a=a, b=b: y and a <= y <= b) for a, b in asked if seen & set(range(a, b + 1))}
    assert got == want and len(found) == len(want) and want[2004, 2006] == (0, 0)


def test_spans_meet_sums_only(spark, rows):
    spans = spark.createDataFrame([(1999, 2001)], "first_year int, last_year int")
    plan = plan_of(report.counts_of_spans(spark.createDataFrame(rows, OBS), spans))
    join = plan.index("Join")
    assert "count(unit_id" in plan[join:] and "count(" not in plan[:join] and "Expand" not in plan
