"""Small inputs with values worked out by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from landflux.functions import fit_per_group, map_factor, response_curve_rows, to_unit
from landflux.operators import checks, factors, fluxes, land, prepare, report, uncertainty
from landflux.sources import literals, read_factors, read_ledger, write_ledger
from landflux.sources.schemas import FACTOR, LEDGER

D = dt.date
STATE = "unit_id bigint, year int, land_use string"
OBS = "unit_id bigint, obs_date date, land_use string, area_ha decimal(18,4), provider_id bigint"
EVENT = "unit_id bigint, event_date date, kind string, severity double, volume_m3 decimal(18,4)"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(
        [(1, 3, "BUILDING", Decimal(10)), (2, 4, "FURNITURE", Decimal(20))],
        "unit_id bigint, country_id int, zone string, area_ha decimal(18,4)",
    )


@pytest.fixture(scope="module")
def factor(spark):
    return literals.small_table(spark, literals.FACTOR_ROWS, FACTOR)


@pytest.fixture(scope="module")
def there_and_back(spark):
    """Forest, cropland for two years, forest again."""
    uses = ["forest", "forest", "cropland", "cropland", "forest", "forest", "forest"]
    return spark.createDataFrame([(1, 1995 + i, u) for i, u in enumerate(uses)], STATE)


def test_dominant_class_ties_go_to_the_first_name(spark):
    obs = spark.createDataFrame(
        [
            (1, D(2000, 1, 1), "wetland", Decimal(5), 1),
            (1, D(2000, 5, 1), "cropland", Decimal(2), 1),
            (1, D(2000, 6, 1), "cropland", Decimal(3), 2),
            (1, D(2001, 6, 1), "other", Decimal(0), 2),
        ],
        OBS,
    )
    assert rows(land.dominant_land_use(obs), "year") == [
        (1, 2000, "cropland", Decimal("5.0000")),
        (1, 2001, "other", Decimal("0.0000")),
    ]


def test_unknown_class_stops_the_job(spark):
    obs = spark.createDataFrame([(1, D(2000, 1, 1), "lava", Decimal(5), 1)], OBS)
    with pytest.raises(Exception, match="unknown land use: lava"):
        land.dominant_land_use(obs).collect()


def test_densify_carries_on_and_leaves_the_start_empty(spark):
    seen = [(1, 1996, "forest"), (1, 1999, "other"), (2, 1990, "wetland"), (3, 2005, "forest")]
    st = prepare.densify_years(spark.createDataFrame(seen, STATE), 1995, 2000)
    assert rows(st.filter("unit_id = 1"), "year") == [
        (1, 1995, None, False),
        (1, 1996, "forest", True),
        (1, 1997, "forest", False),
        (1, 1998, "forest", False),
        (1, 1999, "other", True),
        (1, 2000, "other", False),
    ]
    # seen before the period: carried into it; seen after it: nothing known in it
    assert rows(st.filter("unit_id = 2").select("land_use", "observed").distinct(), "land_use") == [
        ("wetland", False)
    ]
    assert rows(st.filter("unit_id = 3").select("land_use").distinct(), "land_use") == [(None,)]
    assert st.filter("unit_id = 3").count() == 6


def test_spells_categories_and_returns(there_and_back):
    assert rows(land.land_use_spells(there_and_back).drop("unit_id"), "spell") == [
        (1, "forest", 1995, 1996, 2),
        (2, "cropland", 1997, 1998, 2),
        (3, "forest", 1999, 2001, 3),
    ]
    categories = land.remaining_or_converted(there_and_back, period=2)
    assert [r[4] for r in rows(categories, "year")] == [
        "forest remaining forest",
        "forest remaining forest",
        "land converted to cropland",
        "land converted to cropland",
        "land converted to forest",
        "land converted to forest",
        "forest remaining forest",
    ]
    assert rows(land.first_loss_year(there_and_back, "forest"), "unit_id") == [(1, 1997, "cropland")]
    assert rows(land.return_transitions(there_and_back, 2), "unit_id") == [(1, "forest", 1997, 1999, 2)]
    assert land.return_transitions(there_and_back, 1).count() == 0


def test_transition_matrix_rows_add_up_to_the_area(there_and_back, units):
    matrix = land.transition_matrix(there_and_back, units, ["year"])
    per_year = matrix.groupBy("year").agg(F.sum("area_ha").alias("a")).collect()
    assert {r.a for r in per_year} == {Decimal(10)} and len(per_year) == 6


def test_tiers_and_validity(spark, factor):
    keys = spark.createDataFrame(
        [
            (1, 3, "BUILDING", "forest", 2000),
            (2, 4, "BUILDING", "forest", 2000),
            (3, 4, "MACHINERY", "forest", 1997),
            (4, 4, "MACHINERY", "forest", 1998),
            (5, 4, "FURNITURE", "forest", 2000),
            (6, 4, "FURNITURE", "cropland", 2000),
            (7, None, None, None, 2000),
            (8, 3, "BUILDING", "forest", 1980),
        ],
        "id int, country_id int, zone string, land_use string, year int",
    )
    found = factors.resolve_factor(keys, factor, "growth").select("id", "growth", "growth_tier")
    assert rows(found, "id") == [
        (1, 6.25, 1),
        (2, 5.5, 4),
        (3, 3.25, 4),
        (4, 3.625, 4),
        (5, 1.1, 5),
        (6, 1.1, 5),
        (7, 0.5, 8),
        (8, None, None),
    ]
    assert [r[0] for r in rows(factors.missing_factors(keys, factor, "growth").select("year"), "year")] == [1980]


def test_overlapping_validity_takes_the_later_start(spark):
    f = literals.small_table(
        spark,
        [
            ("p", None, None, "forest", 1990, 2050, 1.0, "u", 0.1),
            ("p", None, None, "forest", 2000, 2005, 2.0, "u", 0.1),
        ],
        FACTOR,
    )
    st = spark.createDataFrame([(1, y, "forest") for y in (1999, 2000, 2005, 2006)], STATE)
    found = factors.factor_in_force(st, f, "p")
    assert [r[3] for r in rows(found, "year")] == [1.0, 2.0, 2.0, 1.0]


def test_survey_of_the_same_day_counts(spark):
    events = spark.createDataFrame(
        [(1, D(2000, 1, 5)), (1, D(2000, 1, 5)), (1, D(1999, 1, 1)), (2, D(2000, 1, 1))],
        "unit_id bigint, event_date date",
    )
    surveys = spark.createDataFrame(
        [(1, D(2000, 1, 1), 1, 5.0), (1, D(2000, 1, 5), 2, 6.0), (1, D(2000, 1, 5), 3, 7.0)],
        "unit_id bigint, survey_date date, plot_obs_id bigint, c_density double",
    )
    out = factors.latest_before(
        events, surveys, "unit_id", "event_date", "survey_date", ["plot_obs_id"], [F.desc("plot_obs_id")]
    )
    assert rows(out, "unit_id", "event_date") == [
        (1, D(1999, 1, 1), None, None),
        (1, D(2000, 1, 5), D(2000, 1, 5), 3),
        (1, D(2000, 1, 5), D(2000, 1, 5), 3),
        (2, D(2000, 1, 1), None, None),
    ]


def test_biomass_gain_by_hand(there_and_back, units, factor):
    gain = fluxes.biomass_gain(there_and_back, units, factor).filter("year in (1995, 1997)")
    got = {(r.year, r.pool): r.amount for r in gain.collect()}
    # 10 ha * 6.25 * 0.47 and, as cropland, 10 * 0.5 * 0.47; roots 0.26 and 0.3
    assert got == {
        (1995, "AGB"): Decimal("29.3750"),
        (1995, "BGB"): Decimal("7.6375"),
        (1997, "AGB"): Decimal("2.3500"),
        (1997, "BGB"): Decimal("0.7050"),
    }


def test_conversion_and_legacy_stop_at_the_next_change(there_and_back, units, factor, spark):
    conv = fluxes.conversion_biomass(there_and_back, units, factor)
    assert [(r.year, r.pool, r.amount) for r in conv.orderBy("year", "pool").collect()] == [
        (1997, "AGB", Decimal(-1150)),
        (1997, "BGB", Decimal(-297)),  # root ratios 0.26 in forest, 0.3 elsewhere
        (1999, "AGB", Decimal(1150)),
        (1999, "BGB", Decimal(297)),
    ]
    dom = fluxes.dom_conversion(there_and_back, units, factor, period=4, until=2001)
    dw = [(r.year, r.amount) for r in dom.filter("pool = 'DW'").orderBy("year").collect()]
    # 14 tC/ha on 10 ha over 4 years; the first change acts two years only
    assert dw == [(y, Decimal(-35)) for y in (1997, 1998)] + [(y, Decimal(35)) for y in (1999, 2000, 2001)]
    curves = spark.createDataFrame(
        [("forest", "cropland", a, -1.0, "AGB") for a in range(5)]
        + [("cropland", "forest", a, 2.0, "AGB") for a in range(2)],
        "from_use string, to_use string, age int, share double, pool string",
    )
    legacy = fluxes.bookkeeping(there_and_back, units, curves, until=2001)
    assert [(r.year, r.amount) for r in legacy.orderBy("year").collect()] == [
        (1997, Decimal(-10)),
        (1998, Decimal(-10)),
        (1999, Decimal(20)),
        (2000, Decimal(20)),
    ]


def test_fires_of_one_year_are_capped_at_the_stock(spark, units, factor):
    st = spark.createDataFrame([(1, 2000, "forest"), (2, 2000, "cropland")], STATE)
    events = spark.createDataFrame(
        [
            (1, D(2000, 3, 1), "fire", 0.8, Decimal(1)),
            (1, D(2000, 8, 1), "fire", 0.7, Decimal(1)),
            (2, D(2000, 8, 1), "fire", 0.0, Decimal(1)),
            (2, D(2000, 8, 1), "harvest", 0.5, Decimal(10)),
        ],
        EVENT,
    )
    lost = fluxes.disturbance_loss(events, st, units, factor).filter("pool = 'AGB'")
    assert {(r.unit_id, r.amount) for r in lost.collect()} == {(1, Decimal(-1200)), (2, Decimal(0))}
    cut = fluxes.harvest_loss(events, units, factor).filter("pool = 'AGB'").collect()
    assert [r.amount for r in cut] == [Decimal("-2.8200")]  # 10 * 0.6 * 0.47


def test_products_follow_the_yearly_recursion(spark, units, factor):
    import math

    events = spark.createDataFrame(
        [(1, D(y, 3, 1), "harvest", 0.0, Decimal(v)) for y, v in [(1995, 1000), (1997, 500), (2000, 800)]],
        EVENT,
    )
    pool = fluxes.hwp_pool(fluxes.harvest_carbon(events, units, factor), until=2001)
    got = {r.year: float(r.stock) for r in pool.collect()}
    k, stock = 0.0231, 0.0
    inflow = {y: v * 0.75 * 0.47 * 0.55 for y, v in [(1995, 1000), (1997, 500), (2000, 800)]}
    for year in range(1995, 2002):
        stock = math.exp(-k) * stock + (1 - math.exp(-k)) / k * inflow.get(year, 0.0)
        assert got[year] == pytest.approx(stock, abs=0.001)
        assert got[year] >= 0


def test_debris_is_lost_once(spark, units, factor):
    events = spark.createDataFrame([(1, D(1900 + 95, 1, 1), "harvest", 0.0, Decimal(1000))], EVENT)
    lost = fluxes.delayed_decay(fluxes.harvest_carbon(events, units, factor), until=2050)
    total = -float(lost.agg(F.sum("amount")).first()[0])
    assert total == pytest.approx(1000 * 0.75 * 0.47 * 0.3, rel=0.01)


def test_stock_difference(spark, units):
    surveys = spark.createDataFrame(
        [(1, D(2000, 1, 1), 100.0), (1, D(2004, 1, 1), 120.0)],
        "unit_id bigint, survey_date date, c_density double",
    )
    (row,) = fluxes.stock_difference(surveys, units).collect()
    assert row.days == 1461 and row.amount == Decimal("50.0000")  # 20 tC/ha * 10 ha in 4 years


def test_gases_to_co2e(spark):
    entries = spark.createDataFrame(
        [
            (1, 2000, "AGB", "fire", "CO2", Decimal(-12), "tC"),
            (1, 2000, "AGB", "fire", "CH4", Decimal(-2), "t gas"),
        ],
        LEDGER,
    )
    gwp = literals.small_table(spark, literals.GWP_ROWS, "gwp_set string, gas string, value double")
    got = {r.gas: r.co2e for r in fluxes.co2e(entries, gwp, "AR5").collect()}
    assert got == {"CO2": Decimal(44), "CH4": Decimal(56)}
    # a gas without a potential stops the job: a null would drop out of every sum
    with pytest.raises(Exception, match="no warming potential"):
        fluxes.co2e(entries.withColumn("gas", F.lit("SF6")), gwp, "AR5").collect()


@pytest.fixture(scope="module")
def small_ledger(spark):
    return spark.createDataFrame(
        [
            (1, 2000, "AGB", "growth", "CO2", Decimal(10), "tC"),
            (1, 2000, "AGB", "harvest", "CO2", Decimal(-4), "tC"),
            (1, 2001, "AGB", "growth", "CO2", Decimal(6), "tC"),
            (1, 2003, "AGB", "growth", "CO2", Decimal(2), "tC"),
            (2, 2000, "LITTER", "transfer", "CO2", Decimal(-3), "tC"),
            (2, 2000, "SOC", "transfer", "CO2", Decimal(3), "tC"),
            (2, 2001, "SOC", "growth", "CO2", Decimal(-8), "tC"),
        ],
        LEDGER,
    )


def test_reports_mind_missing_years(small_ledger):
    one = small_ledger.filter("unit_id = 1")
    assert [r[-1] for r in rows(report.moving_mean(one, ["unit_id"], 2), "year")] == [6.0, 6.0, 2.0]
    change = [r.change for r in report.year_on_year(one, ["unit_id"]).orderBy("year").collect()]
    assert change == [None, 0.0, None]
    total = report.cumulative_flux(one, ["unit_id"], 2001).orderBy("year").collect()
    assert [r.cumulative for r in total] == [Decimal(6), Decimal(8)]


def test_zero_totals_give_null_ratios(spark):
    entries = spark.createDataFrame(
        [(1, y, "AGB", "growth", "CO2", Decimal(a), "tC") for y, a in [(2000, 5), (2000, -5), (2001, 3)]],
        LEDGER,
    )
    changed = report.year_on_year(entries, ["unit_id"]).orderBy("year").collect()
    assert changed[1].change == 3.0 and changed[1].relative is None
    parts = entries.filter("year = 2000").withColumn("rel_unc", F.lit(0.5))
    (row,) = uncertainty.propagate_sum(parts, ["year"]).collect()
    assert row.amount == 0 and row.rel_unc is None


def test_gross_and_net(small_ledger):
    (row,) = fluxes.gross_and_net(small_ledger, ["gas"]).collect()
    assert (row.removals, row.emissions, row.net) == (Decimal(21), Decimal(15), Decimal(6))


def test_top_emitters_keep_or_break_ties(small_ledger):
    both = small_ledger.filter("amount in (-3, -4)").withColumn("amount", F.lit(Decimal(-3)))
    assert report.top_emitters(both, 1, "gas", "unit_id").count() == 1
    assert report.top_emitters(both, 1, "gas", "unit_id", keep_ties=True).count() == 2


def test_key_categories(spark):
    entries = spark.createDataFrame(
        [(1, 2000, p, "x", "CO2", Decimal(a), "tC") for p, a in [("AGB", 80), ("SOC", -15), ("DW", 4), ("HWP", 1)]],
        LEDGER,
    )
    kept = report.key_categories(entries, ["pool"], 0.95).orderBy("cumulative_share").collect()
    assert [r.pool for r in kept] == ["AGB", "SOC"]
    assert report.key_categories(entries, ["unit_id"]).collect()[0].amount == 70  # any column may be a key


def test_carbon_balance(spark, small_ledger):
    stocks = spark.createDataFrame(
        [
            (1, 1999, "AGB", Decimal(100)),
            (1, 2000, "AGB", Decimal(106)),
            (1, 2001, "AGB", Decimal(113)),
            (2, 1999, "LITTER", Decimal(9)),
            (2, 2000, "LITTER", Decimal(6)),
            (2, 1999, "SOC", Decimal(50)),
            (2, 2000, "SOC", Decimal(53)),
            (2, 2001, "SOC", Decimal(45)),
            (3, 1999, "SOC", Decimal(1)),
            (3, 2000, "SOC", Decimal(2)),
        ],
        "unit_id bigint, year int, pool string, stock decimal(18,4)",
    )
    out = checks.all_carbon_check(small_ledger, stocks)
    assert {(r.unit_id, r.year, r.pool, r.status) for r in out.collect()} == {
        (1, 2000, "AGB", "balanced"),
        (1, 2001, "AGB", "off"),
        (1, 2003, "AGB", "no stock"),
        (2, 2000, "LITTER", "balanced"),
        (2, 2000, "SOC", "balanced"),
        (2, 2001, "SOC", "balanced"),
        (3, 2000, "SOC", "no flux"),
    }


def test_land_balance_finds_doubles_and_gaps(spark, units):
    st = spark.createDataFrame([(1, 2000, "forest"), (2, 2000, None), (1, 2001, "forest"), (1, 2001, "other")], STATE)
    got = {r.year: r for r in checks.all_land_check(st, units).collect()}
    assert got[2000].balanced and got[2000].unobserved_ha == Decimal(20)
    assert not got[2001].balanced and got[2001].n_doubled == 1 and got[2001].missing_ha == Decimal(20)
    missing = checks.units_without_class(st.filter("unit_id = 1"), units, 2000, 2001)
    assert rows(missing, "year") == [(2, 2000, "never observed"), (2, 2001, "never observed")]


def test_compare_runs(spark, small_ledger):
    other = small_ledger.filter("year <> 2003").withColumn(
        "amount", F.when(F.col("pool") == "SOC", F.col("amount") + 1).otherwise(F.col("amount"))
    )
    extra = spark.createDataFrame([(9, 2000, "AGB", "growth", "CO2", Decimal(1), "tC")], LEDGER)
    out = checks.compare_runs(small_ledger, other.unionByName(extra))
    assert {(r.unit_id, r.year, r.change) for r in out.collect()} == {
        (1, 2003, "removed"),
        (2, 2000, "changed"),
        (2, 2001, "changed"),
        (9, 2000, "added"),
    }


def test_units_and_rules(spark):
    df = spark.createDataFrame([(1, 12.0), (2, None)], "id int, c double")
    assert to_unit(df, "c", "C", "CO2").first().c == 44.0
    with pytest.raises(ValueError):
        to_unit(df, "c", "C", "ha")
    rules = {"known": F.col("c").isNotNull(), "large": F.col("c") > 10, "first": F.col("id") == 1}
    assert [r.id for r in prepare.valid_rows(df, rules).collect()] == [1]
    assert prepare.rejected_rows(df, rules).first().broken == "known;large;first"


def test_points_on_box_edges(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 5.0), (3, 5.0, -0.1)], "unit_id bigint, lon double, lat double")
    boxes = spark.createDataFrame(
        [(1, 0.0, 10.0, 0.0, 10.0), (2, -50.0, 50.0, -50.0, 50.0)],
        "box_id int, lon0 double, lon1 double, lat0 double, lat1 double",
    )
    found = prepare.zones_of_points(points, boxes).select("unit_id", "box_id")
    assert rows(found, "unit_id", "box_id") == [(1, 1), (1, 2), (2, 2), (3, 2)]


def test_factor_file_with_a_bad_row_fails(spark, tmp_path):
    head = "param,country_id,zone,land_use,valid_from,valid_to,value,unit,rel_unc\n"
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text(head + "growth,,,forest,1990,2050,4.0,t,0.3\n")
    bad.write_text(head + "growth,,,forest,1990,2050,four,t,0.3\n")
    row = read_factors(spark, str(good)).first()
    assert row.value == 4.0 and row.country_id is None
    with pytest.raises(Exception, match="MALFORMED|four"):
        read_factors(spark, str(bad)).collect()


def test_ledger_years_are_replaced_alone(spark, small_ledger, tmp_path):
    path = str(tmp_path / "ledger")
    write_ledger(small_ledger, path)
    write_ledger(small_ledger.filter("year = 2000").withColumn("amount", F.lit(Decimal(1))), path)
    write_ledger(small_ledger.filter("year = 2000").withColumn("amount", F.lit(Decimal(1))), path)
    stored = read_ledger(spark, path)
    assert stored.count() == 7
    assert {r.amount for r in stored.filter("year = 2000").collect()} == {Decimal(1)}
    assert stored.filter("year = 2003").first().amount == Decimal(2)


def test_user_fit_on_points_equals_fit_on_rows(spark):
    import numpy as np

    data = [(g, x, 3.0 * x + g + (i % 3)) for g in (1, 2) for x in range(6) for i in range(x + 1)]
    df = spark.createDataFrame(data, "g int, x int, y double")

    def line(x, y, n, _):
        slope, start = np.polyfit(x, y, 1, w=np.sqrt(n))
        return float(slope), float(start)

    fits = fit_per_group(df, ["g"], "x", "y", line, "slope double, start double")
    for row in fits.collect():
        mine = [(x, y) for g, x, y in data if g == row.g]
        slope, start = np.polyfit(*zip(*mine, strict=True), 1)
        assert row.slope == pytest.approx(slope) and row.start == pytest.approx(start)


def test_user_scalars_and_tables(spark):
    df = spark.createDataFrame([(1, 8.0, 0.5, 3), (2, None, 0.5, 3)], "id int, total double, rate double, years int")
    doubled = map_factor(df, "total", lambda s: s * 2, "twice").orderBy("id").collect()
    assert doubled[0].twice == 16.0
    curve = response_curve_rows(df, "total", "rate", "years").select("id", "age", "share")
    assert rows(curve, "age") == [(1, 0, 4.0), (1, 1, 2.0), (1, 2, 2.0)]
