"""Inputs outside the fixtures' easy ground: far years, odd scopes, nulls, gaps, mixed units."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from landflux.operators import checks, factors, fluxes, land, prepare, report
from landflux.sources import literals
from landflux.sources.schemas import FACTOR, GWP, READING
from landflux.streaming import towers

LEDGER = "unit_id bigint, year int, pool string, process string, gas string, amount decimal(18,4), unit string"
STATE = "unit_id bigint, year int, land_use string, observed boolean"
UNITS = "unit_id bigint, country_id int, zone string, area_ha decimal(18,4)"
T0 = dt.datetime(2024, 1, 1)


def factor_table(spark, rows):
    return literals.small_table(spark, [(*r, "u", 0.1) for r in rows], FACTOR)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([(1, 7, "Z", Decimal(10)), (2, None, None, Decimal(5))], UNITS)


def test_no_year_is_out_of_reach(spark, units):
    f = factor_table(
        spark,
        [
            ("growth", None, None, None, 1850, 2100, 1.0),
            ("root_ratio", None, None, None, None, None, 0.5),
            ("carbon_fraction", None, None, None, None, 3000, 1.0),
        ],
    )
    years = [1849, 1850, 1989, 2051, 2100, 2101]
    state = spark.createDataFrame([(1, y, "forest", True) for y in years], STATE)
    out = fluxes.biomass_gain(state, units, f).filter("pool = 'AGB'")
    assert [r[1] for r in rows_of(out, "year")] == years[1:-1]


def test_every_scope_counts(spark):
    f = factor_table(
        spark,
        [
            ("p", None, None, None, None, None, 1.0),
            ("p", 7, None, None, 2000, None, 2.0),
            ("p", None, "Z", None, None, None, 3.0),
            ("p", 8, None, "forest", None, None, 4.0),
            ("p", 8, "Z", None, None, None, 5.0),
        ],
    )
    keys = spark.createDataFrame(
        [(1, 7, "Z", "forest", 1999), (2, 7, "Y", "forest", 2000), (3, 8, "Y", "forest", 2000), (4, 8, "Z", "forest", 2000),
         (5, None, "Z", None, 2000), (6, 9, "Y", "cropland", 2000), (7, None, None, None, None)],
        "id int, country_id int, zone string, land_use string, year int",
    )
    out = factors.resolve_factor(keys, f, "p").select("id", "p", "p_tier")
    assert rows_of(out, "id") == [
        (1, 3.0, 6), (2, 2.0, 5), (3, 4.0, 3), (4, 5.0, 2), (5, 3.0, 6), (6, 1.0, 8), (7, 1.0, 8),
    ]


def test_repeated_factor_rows_give_one_whole_row(spark):
    rows = [("p", None, None, None, 1990, 2050, v, "u", u) for v, u in ((2.0, 0.2), (1.0, 0.3), (1.0, 0.1))]
    keys = spark.createDataFrame([(2000,)], "year int")
    out = factors.resolve_factor(keys, literals.small_table(spark, rows, FACTOR), "p").first()
    assert (out.p, out.p_unc) == (1.0, 0.1)


def test_one_lookup_join_a_call(spark, conf):
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    f = factor_table(spark, [("a", None, None, None, None, None, 1.0), ("b", 7, None, None, None, None, 1.0)])
    keys = spark.range(100).selectExpr("cast(id % 3 as int) as country_id", "'Z' as zone", "'x' as land_use", "2000 as year")
    plan = factors.resolve_factors(keys, f, ["a", "b"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 2  # distinct keys with the factors, and the answer with the rows


def test_changes_and_harvests_after_until(spark, units):
    f = factor_table(
        spark,
        [("dead_wood", None, None, "forest", None, None, 8.0), ("dead_wood", None, None, "cropland", None, None, 0.0),
         ("litter", None, None, None, None, None, 0.0)],
    )
    state = spark.createDataFrame([(1, y, "forest" if y < 2003 else "cropland", True) for y in range(2000, 2005)], STATE)
    assert fluxes.dom_conversion(state, units, f, period=4, until=2001).count() == 0
    later = fluxes.dom_conversion(state, units, f, period=4, until=2004).filter("pool = 'DW'")
    assert [r[1] for r in rows_of(later, "year")] == [2003, 2004]
    cut = spark.createDataFrame(
        [(1, 7, 2000, 100.0, 0.5, 0.1, 0.2, 5.0), (1, 7, 2003, 100.0, 0.5, 0.1, 0.2, 5.0)],
        "unit_id bigint, country_id int, year int, carbon double, product_share double, product_decay double, "
        "debris_share double, debris_years double",
    )
    assert [r.year for r in fluxes.hwp_pool(cut, until=2001).orderBy("year").collect()] == [2000, 2001]
    assert [r.year for r in fluxes.delayed_decay(cut, until=2001).orderBy("year").collect()] == [2000, 2001]
    forever = fluxes.hwp_pool(cut.withColumn("product_decay", F.lit(0.0)), until=2004).orderBy("year").collect()
    assert [float(r.stock) for r in forever] == [50.0, 50.0, 50.0, 100.0, 100.0]


def test_transfers_close(spark):
    cut = spark.createDataFrame(
        [(1, y, 100.0 + y % 7, 0.5, 0.1, 0.2, 5.0, 0.3) for y in (2000, 2001, 2004)],
        "unit_id bigint, year int, carbon double, product_share double, product_decay double, debris_share double, "
        "debris_years double, root_ratio double",
    )
    flows = fluxes.ledger(fluxes.harvest_gains(cut), fluxes.product_decay(cut, 2006), fluxes.delayed_decay(cut, 2006))
    stocks = fluxes.harvest_stocks(cut, 2006).filter("year not in (2002, 2003)")
    out = checks.all_carbon_check(flows, stocks, tolerance=0.01)
    found = {(r.year, r.pool): r.status for r in out.collect()}
    assert {s for (y, _), s in found.items() if y > 2000} == {"balanced"}
    assert {y for y, _ in found} == {2000, 2001, 2004, 2005, 2006}


def test_pools_without_stock_and_flux_are_listed(spark, units):
    flows = spark.createDataFrame([(1, 2000, "AGB", "growth", "CO2", Decimal(1), "tC")], LEDGER)
    stocks = spark.createDataFrame([(1, 2000, "SOC", Decimal(1))], "unit_id bigint, year int, pool string, stock decimal(18,4)")
    out = checks.missing_pools(flows, stocks, units, ["AGB", "SOC", "DW"])
    assert rows_of(out, "unit_id", "pool") == [(1, "DW"), (2, "AGB"), (2, "DW"), (2, "SOC")]


def test_units_are_not_mixed(spark):
    mixed = spark.createDataFrame(
        [(1, 2000, "AGB", "growth", "CO2", Decimal(-100), "tC"), (1, 2000, "AGB", "fire", "CH4", Decimal(-3), "t gas")], LEDGER
    )
    with pytest.raises(Exception, match="are not added"):
        report.report_rollup(mixed, ["year"]).collect()
    with pytest.raises(Exception, match="are not added"):
        report.key_categories(mixed, ["gas"]).collect()
    gwp = literals.small_table(spark, literals.GWP_ROWS, GWP)
    total = report.totals(fluxes.in_co2e(mixed, gwp, "AR6"), ["year"]).first()
    assert float(total.amount) == pytest.approx(-100 * 44 / 12 - 81, abs=1e-3)
    with pytest.raises(Exception, match="no warming potential"):
        fluxes.co2e(mixed.withColumn("gas", F.lit("SF6")), gwp, "AR6").collect()


def test_groups_without_a_key_stay(spark):
    rows = [(k, 2000, "AGB", "growth", "CO2", Decimal(k), "tC") for k in range(8)]
    placed = spark.createDataFrame(rows, LEDGER).withColumn("region_id", F.when(F.col("unit_id") < 4, F.lit(1)))
    assert {r.region_id for r in report.distribution(placed, ["region_id"]).collect()} == {1, None}
    assert report.unit_quartiles(placed, ["region_id"]).count() == 8


def test_a_null_is_no_observation(spark):
    rows = [(1, 2000, "forest"), (1, 2002, None), (2, 2001, None)]
    out = prepare.densify_years(spark.createDataFrame(rows, "unit_id bigint, year int, land_use string"), 1999, 2003)
    assert rows_of(out, "year") == [
        (1, 1999, None, False), (1, 2000, "forest", True), (1, 2001, "forest", False), (1, 2002, "forest", False),
        (1, 2003, "forest", False),
    ]


def test_a_box_over_the_date_line(spark):
    points = spark.createDataFrame([(1, 175.0, 0.0), (2, -175.0, 0.0), (3, 0.0, 0.0)], "unit_id int, lon double, lat double")
    boxes = spark.createDataFrame([(9, 170.0, -170.0, -5.0, 5.0)], "box_id int, lon0 double, lon1 double, lat0 double, lat1 double")
    assert rows_of(prepare.zones_of_points(points, boxes).select("unit_id", "box_id"), "unit_id") == [(1, 9), (2, 9)]


def test_an_unknown_class_is_refused(spark):
    obs = spark.createDataFrame(
        [(1, dt.date(2000, 1, 1), "tundra", Decimal(1), 5)],
        "unit_id bigint, obs_date date, land_use string, area_ha decimal(18,4), provider_id bigint",
    )
    with pytest.raises(Exception, match="unknown land use"):
        land.provider_agreement(obs).collect()


def test_foreign_land_is_not_balanced(spark, units):
    state = spark.createDataFrame([(1, 2000, "forest", True), (2, 2000, "forest", True), (99, 2000, "forest", True)], STATE)
    row = checks.all_land_check(state, units).first()
    assert (row.n_foreign, row.balanced, float(row.missing_ha)) == (1, False, 0.0)


def test_claims_are_read_once(spark):
    claims = spark.range(50).selectExpr(
        "cast(id as string) as claim_id", "id % 5 as unit_id", "date_add(date'2000-01-01', cast(id as int)) as start_date",
        "date_add(date'2000-01-01', cast(id as int) + 3) as end_date",
    )
    assert checks.double_count(claims).count() == 0
    assert checks.double_count(claims.withColumn("unit_id", F.lit(1))).count() == 50


def test_fine_fluxes_and_lone_towers(spark):
    small = spark.createDataFrame(
        [(i, 1, T0 + dt.timedelta(minutes=i), "view", i * 1e-6, 1.0) for i in range(9)] + [(99, 1, T0, "view", 1e-3, 1.0)], READING
    )
    assert towers.despike(small, 3.0, digits=8).count() == 9
    fit = towers.respiration_fit(small.filter("flux > 1"))
    kept = towers.partition_nee(small, fit)
    assert kept.count() == 10 and kept.filter("respiration is not null").count() == 0
    filled = towers.gap_fill(towers.half_hour_means(small), "2024-01-01", "2024-01-06")
    assert filled.count() == 6 * 48 and filled.filter("flux is null").count() == 6 * 47


def test_rows_that_are_not_booked_are_listed(spark, units):
    f = factor_table(spark, [("p", 7, None, "forest", None, None, 1.0)])
    rows = spark.createDataFrame([(1, 2000), (1, 2000), (1, 2001), (1, 2002), (2, 2000), (99, 2000)], "unit_id bigint, year int")
    state = spark.createDataFrame(
        [(1, 2000, "forest", True), (1, 2001, "cropland", True), (2, 2000, "forest", True)], STATE
    )
    out = checks.unbooked_rows(rows, state, units, f, ["p"])
    assert rows_of(out, "unit_id", "year") == [
        (1, 2001, 1, "no factor"), (1, 2002, 1, "no class"), (2, 2000, 1, "no factor"), (99, 2000, 1, "no unit"),
    ]
