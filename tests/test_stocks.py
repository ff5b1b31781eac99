"""Stocks rolled on from year to year, against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from plan_rows import rows_made
from pyspark.sql import functions as F

from landflux.operators import fluxes, scans, stocks
from landflux.sources.schemas import FACTOR
from landflux.sources.literals import small_table

STATE = "unit_id bigint, year int, land_use string"
EVENT = "unit_id bigint, event_date date, kind string, severity double, volume_m3 decimal(18,4)"
HARVEST = (
    "unit_id bigint, country_id int, year int, carbon double, product_share double, product_decay double, "
    "debris_share double, debris_years double"
)
FACTORS = [
    ("biomass", None, None, "forest", None, None, 100.0, "tC/ha", 0.1),
    ("biomass", None, None, "cropland", None, None, 5.0, "tC/ha", 0.1),
    ("growth", None, None, "forest", None, None, 4.0, "t/ha", 0.1),
    ("growth", None, None, "cropland", None, None, 0.0, "t/ha", 0.1),
    ("carbon_fraction", None, None, None, None, None, 0.5, "", 0.1),
    ("root_ratio", None, None, None, None, None, 0.25, "", 0.1),
    ("expansion", None, None, None, None, None, 1.0, "", 0.1),
]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(
        [(i, 3, "BUILDING", Decimal(10)) for i in range(40)], "unit_id bigint, country_id int, zone string, area_ha decimal(18,4)"
    )


@pytest.fixture(scope="module")
def factor(spark):
    return small_table(spark, FACTORS, FACTOR)


def event(unit, year, kind, size):
    return (unit, dt.date(year, 5, 1), kind, size if kind == "fire" else 0.0, Decimal(str(size if kind == "harvest" else 0)))


def rolled(spark, units, factor, state, events, years):
    frame = spark.createDataFrame(events, EVENT)
    out = stocks.biomass_stocks(spark.createDataFrame(state, STATE), frame, units, factor, years)
    return out, {(r.unit_id, r.year): r for r in out.collect()}


def test_two_fires_and_a_harvest_take_what_stands(spark, units, factor):
    """1000 tC stand. A fire takes 800, 20 grow, the next asks for 700 and gets 220, a harvest gets what has grown."""
    state = [(1, y, "forest") for y in range(2000, 2005)]
    events = [event(1, 2001, "fire", 0.5), event(1, 2001, "fire", 0.3), event(1, 2002, "fire", 0.7), event(1, 2003, "harvest", 400)]
    out, got = rolled(spark, units, factor, state, events, (2000, 2004))
    shown = [(int(got[1, y].gained), int(got[1, y].harvested), int(got[1, y].burned), int(got[1, y].stock)) for y in range(2000, 2005)]
    assert shown == [(0, 0, 0, 1000), (0, 0, 800, 200), (20, 0, 220, 0), (20, 20, 0, 0), (20, 0, 0, 20)]
    lost = {(r.year, r.process, r.pool): r.amount for r in stocks.capped_losses(out).collect()}
    assert lost == {
        (2001, "fire", "AGB"): -800, (2001, "fire", "BGB"): -200, (2002, "fire", "AGB"): -220, (2002, "fire", "BGB"): -55,
        (2003, "harvest", "AGB"): -20, (2003, "harvest", "BGB"): -5,
    }
    # factors alone burn more than ever stood
    burned = fluxes.disturbance_loss(spark.createDataFrame(events, EVENT), spark.createDataFrame(state, STATE), units, factor)
    assert burned.filter("pool = 'AGB'").agg(F.sum("amount")).first()[0] == -1500


def test_conversion_moves_the_full_stock(spark, units, factor):
    state = [(1, 2000, "forest"), (1, 2001, "cropland"), (1, 2002, "forest"), (1, 2003, "unknown"), (2, 2001, None), (2, 2002, "forest")]
    _, got = rolled(spark, units, factor, state, [event(1, 2002, "fire", 1.0), event(2, 2001, "fire", 1.0)], (2000, 2003))
    assert [float(got[1, y].stock) for y in (2000, 2001, 2002, 2003)] == [1000, 50, 0, 0]
    assert (2, 2001) not in got and got[2, 2002].stock == 1000


def plain_roll(rows):
    """(stock by year) of one unit from (year, use, harvest, severity)."""
    full = {"forest": 1000.0, "cropland": 50.0, None: 0.0}
    out, stock, use_before = {}, None, None
    for year, use, cut, severity in rows:
        if stock is None:
            stock = full[use]
        come = 20.0 if use == "forest" else 0.0
        if use_before is not None and use != use_before:
            come += full[use] - full[use_before]
        stock = min(max(stock + come, 0), full[use])
        stock -= min(cut * 0.5, stock)
        stock -= min(full[use] * min(severity, 1), stock)
        out[year], use_before = stock, use
    return out


def test_random_units_over_a_hundred_years(spark, units, factor):
    rng = random.Random(5)
    state, events, want = [], [], {}
    for unit in range(20):
        rows, use = [], "forest"
        for year in range(1900, 1900 + rng.choice([1, 2, 3, 64, 65, 120])):
            use = rng.choice(["forest", "cropland"]) if rng.random() < 0.15 else use
            cut = rng.choice([0, 0, 0, 30, 400])
            fire = rng.choice([0, 0, 0, 0.25, 0.5, 1.0])
            state.append((unit, year, use))
            events += [event(unit, year, "harvest", cut)] if cut else []
            events += [event(unit, year, "fire", fire)] if fire else []
            rows.append((year, use, cut, fire))
        want |= {(unit, y): s for y, s in plain_roll(rows).items()}
    _, got = rolled(spark, units, factor, state, events, (1900, 2019))
    assert {k: float(r.stock) for k, r in got.items()} == want and min(want.values()) == 0
    assert all(r.harvested <= r.asked_harvest and r.burned <= r.asked_fire and r.stock >= 0 for r in got.values())


def test_a_unit_with_very_many_events_is_one_row_a_year(spark, units, factor):
    state = [(1, y, "forest") for y in (2000, 2001)]
    events = [event(1, 2000 + i % 2, "harvest", 0.25) for i in range(4000)]
    _, got = rolled(spark, units, factor, state, events, (2000, 2001))
    assert float(got[1, 2000].harvested) == 250 and float(got[1, 2001].stock) == 520


def test_steps_compose_in_any_grouping(spark):
    """Clamped steps one after the other equal their composition, however grouped."""
    rng = random.Random(8)
    steps = [(i, rng.randint(-9, 9), *sorted(rng.sample(range(-12, 12), 2))) for i in range(37)]
    df = spark.createDataFrame(steps, "i int, add bigint, low bigint, high bigint").withColumn("k", F.lit(1))
    for longest in (37, 64):
        got = scans.running(df, ["k"], "i", ["add", "low", "high"], scans.compose_clamped, longest).orderBy("i").collect()
        for x in (-30, -3, 0, 4, 30):
            at = x
            for (_, add, low, high), r in zip(steps, got, strict=True):
                at = min(max(at + add, low), high)
                assert min(max(x + r.add, r.low), r.high) == at
    with pytest.raises(Exception, match="more than 36 rows of one key"):
        scans.running(df, ["k"], "i", ["add", "low", "high"], scans.compose_clamped, 36).collect()


def inflows(spark, rows):
    return spark.createDataFrame(rows, HARVEST)


def test_pools_equal_the_yearly_recursion(spark):
    cut = inflows(spark, [(1, 7, y, 100.0 + y % 7, 0.5, 0.05, 0.2, 5.0) for y in (2000, 2001, 2004)] + [(2, 7, 2001, 50.0, 0.5, 0.3, 0.2, 8.0)])
    got = {(r.pool, r.year): r for r in stocks.decaying_pools(cut, ["country_id"], (2000, 2010)).collect()}
    series = {"HWP": [({2000: 105.0, 2001: 106.0, 2004: 102.0}, 0.5, math.exp(-0.05), (1 - math.exp(-0.05)) / 0.05), ({2001: 50.0}, 0.5, math.exp(-0.3), (1 - math.exp(-0.3)) / 0.3)],
              "DW": [({2000: 105.0, 2001: 106.0, 2004: 102.0}, 0.2, math.exp(-0.2), math.exp(-0.2)), ({2001: 50.0}, 0.2, math.exp(-1 / 8), math.exp(-1 / 8))]}
    for pool, parts in series.items():
        stock = [0.0] * len(parts)
        for year in range(2000, 2011):
            before = sum(stock)
            stock = [keep * s + stays * share * come.get(year, 0.0) for s, (come, share, keep, stays) in zip(stock, parts, strict=True)]
            come = sum(share * c.get(year, 0.0) for c, share, _, _ in parts)
            row = got[pool, year]
            assert (row.inflow, row.stock, row.lost) == pytest.approx((come, sum(stock), before + come - sum(stock)), abs=1e-9)
    # the same as the products summed from every inflow
    pool = {r.year: float(r.stock) for r in fluxes.hwp_pool(cut, until=2010).collect()}
    assert {y: r.stock for (p, y), r in got.items() if p == "HWP"} == pytest.approx(pool, abs=0.001)


def test_a_hundred_inflows_make_a_hundred_rows(spark):
    cut = inflows(spark, [(1, 7, y, 100.0, 0.5, 0.05, 0.2, 5.0) for y in range(1900, 2000)])
    df = stocks.decaying_pools(cut, ["unit_id"], (1900, 1999))
    # two pools listed from the harvests, then a row a pool and year
    assert rows_made(df, "Generate") == 200 + 200
    assert rows_made(fluxes.product_decay(cut, 1999), "Generate") > 5000


def test_speeds_of_zero_and_none(spark):
    cut = inflows(spark, [(1, 7, 2000, 100.0, 0.5, 0.0, 0.2, 0.0), (2, 7, 2000, 100.0, 0.5, None, 0.2, None)])
    got = {(r.unit_id, r.pool, r.year): (r.stock, r.lost) for r in stocks.decaying_pools(cut, ["unit_id"], (2000, 2001)).collect()}
    assert got == {(1, "HWP", 2000): (50, 0), (1, "HWP", 2001): (50, 0), (1, "DW", 2000): (0, 20), (1, "DW", 2001): (0, 0)}
    gains = {(r.unit_id, r.pool): r.amount for r in fluxes.harvest_gains(cut).collect()}
    assert gains == {(1, "DW"): 20, (1, "HWP"): 50}
    lost = {(r.unit_id, r.year): float(r.amount) for r in fluxes.delayed_decay(cut, 2001).collect()}
    assert lost == {(1, 2000): -20, (1, 2001): 0}
    standing = {(r.pool, r.year): float(r.stock) for r in fluxes.harvest_stocks(cut.filter("unit_id = 1"), 2001).collect()}
    assert standing == {("DW", 2000): 0, ("DW", 2001): 0, ("HWP", 2000): 50, ("HWP", 2001): 50}


def test_empty_tables(spark, units, factor):
    out, got = rolled(spark, units, factor, [], [], (2000, 2001))
    assert got == {} and stocks.capped_losses(out).count() == 0
    assert stocks.decaying_pools(inflows(spark, []), ["unit_id"], (2000, 2001)).count() == 0
