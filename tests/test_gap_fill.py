"""Filled half hours: against brute force, over several blocks of days, and what is shuffled."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from test_plan_shapes import plan_of

from landflux.streaming import towers

MEANS = "tower_id bigint, start timestamp, mean_flux double"
DAY0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rows():
    rng = random.Random(3)
    made = [(1, DAY0 + dt.timedelta(days=d, minutes=30 * s), rng.gauss(0, 5)) for d in range(150) for s in (0, 21) if rng.random() < 0.3]
    made += [(2, DAY0 + dt.timedelta(days=d, hours=23), float(d)) for d in (0, 60, 63, 64, 71, 72, 127, 128, 149)]
    made += [(2, DAY0 + dt.timedelta(days=60, hours=23), 8.5), (3, DAY0 + dt.timedelta(days=64), None), (3, DAY0 + dt.timedelta(days=65), 4.0)]
    return [*made, (None, DAY0, 1.0), (4, None, 2.0)]


def filled(rows, first, last, days=7):
    out = []
    for tower in {t for t, _, _ in rows}:
        mine = {}
        for t, at, flux in rows:
            if t is not None and t == tower and at is not None and first <= (at - DAY0).days <= last:
                mine.setdefault((at.hour * 2 + at.minute // 30, (at - DAY0).days), []).append(flux)
        for slot in range(48):
            for d in range(first, last + 1):
                near = [f for k in range(max(first, d - days), min(last, d + days) + 1) for f in mine.get((slot, k), []) if f is not None]
                for flux in mine.get((slot, d), [None]):
                    nearby = sum(near) / len(near) if near else None
                    value = nearby if flux is None else flux
                    out.append((tower, d, slot, value if value is None else round(value, 9), flux is None))
    return sorted(out, key=str)


@pytest.mark.parametrize("first,last", [(None, None), (10, 75), (0, 63), (200, 210)])
def test_equals_brute_force(spark, rows, first, last):
    given = [None if d is None else str((DAY0 + dt.timedelta(days=d)).date()) for d in (first, last)]
    found = towers.gap_fill(spark.createDataFrame(rows, MEANS), *given).collect()
    got = [(r.tower_id, (r.day - DAY0.date()).days, r.slot, r.flux if r.flux is None else round(r.flux, 9), r.filled) for r in found]
    assert sorted(got, key=str) == filled(rows, 0 if first is None else first, 149 if last is None else last)


def test_days_without_order_give_no_row(spark, rows):
    means = spark.createDataFrame(rows, MEANS)
    assert towers.gap_fill(means, "2024-02-01", "2024-01-01").count() == 0
    assert towers.gap_fill(means.filter("false")).count() == 0


def test_empty_half_hours_are_not_shuffled(spark, rows, conf):
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    plan = plan_of(towers.gap_fill(spark.createDataFrame(rows, MEANS)).groupBy("tower_id", "day").count())
    assert "Join" not in plan and "Window" not in plan
    above = plan[: plan.index("REPARTITION_BY_COL")]
    assert above.count("Exchange hashpartitioning") == 1 and "Generate explode" in above
