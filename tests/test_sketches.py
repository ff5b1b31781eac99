"""Sketches of years, united for spans, against exact counts and ranks."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from landflux.operators import sketches

OBS = "unit_id bigint, obs_date date, provider_id bigint"
ENTRY = "region_id int, unit_id bigint, year int, amount decimal(18,4), unit string"
PROBS = {"low": 0.1, "median": 0.5, "high": 0.9}


def test_spans_from_sketches_alone(spark, tmp_path):
    """Region 1 holds nine tenths of 60,000 rows; one year is written again with other rows."""
    rng = random.Random(2)
    rows = [(1 if i % 10 else 2, i % 20_000, 2000 + i // 20_000, Decimal(round(rng.gauss(0, 50), 4)), "tC") for i in range(60_000)]
    path = str(tmp_path / "sketches")
    sketches.write_sketches(sketches.flux_sketches(spark.createDataFrame(rows, ENTRY), ["region_id"]), path)
    again = [(r, u, y, a + 1000, unit) for r, u, y, a, unit in rows if y == 2002]
    sketches.write_sketches(sketches.flux_sketches(spark.createDataFrame(again, ENTRY), ["region_id"]), path)
    rows = [r for r in rows if r[2] != 2002] + again

    spans = [(2000, 2000), (2000, 2001), (2000, 2002), (2001, 2002), (2002, 2050), (1900, 1950)]
    asked = spark.createDataFrame([*spans, spans[0]], "first_year int, last_year int")
    found = sketches.distribution_of_spans(sketches.read_sketches(spark, path), asked, ["region_id"], PROBS).collect()
    assert {(r.first_year, r.last_year) for r in found} == set(spans) - {(1900, 1950)} and len(found) == 10
    for r in found:
        held = sorted(float(a) for g, _, y, a, _ in rows if g == r.region_id and r.first_year <= y <= r.last_year)
        units = len({u for g, u, y, _, _ in rows if g == r.region_id and r.first_year <= y <= r.last_year})
        assert r.n == len(held) and abs(r.approx_units - units) <= 4 * sketches.COUNT_ERROR * units
        for name, p in PROBS.items():
            assert r[name] in held
            assert abs(held.index(r[name]) / len(held) - p) <= 2 * sketches.RANK_ERROR + 1 / len(held)


def test_coverage_with_nulls_and_no_rows(spark):
    day = dt.date(2001, 3, 1)
    rows = [(1, day, 5), (1, day, 5), (2, day, None), (None, day, 6), (3, dt.date(2003, 1, 1), 5)]
    asked = spark.createDataFrame([(2001, 2001), (2001, 2003), (2002, 2002)], "first_year int, last_year int")
    obs = spark.createDataFrame(rows, OBS)
    found = sketches.coverage_of_spans(sketches.coverage_sketches(obs), asked).collect()
    assert {tuple(r) for r in found} == {(2001, 2001, 2, 2), (2001, 2003, 3, 2)}
    assert sketches.coverage_of_spans(sketches.coverage_sketches(obs.filter("false")), asked).count() == 0
