"""What must hold for any input."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from landflux.functions import uniform_draw
from landflux.operators import fluxes, land, report, uncertainty
from landflux.plans import REGISTRY, inputs
from landflux.sources import LandTables

SMALL = SF.format("0.001")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["ledger", "double_count", "tower_sessions", "distribution", "bookkeeping"])
def test_partition_count_does_not_matter(spark, conf, name):
    got = []
    for n in ("1", "8"):
        conf({"spark.sql.shuffle.partitions": n})
        got.append(rows(REGISTRY[name].run(spark, SMALL)))
    assert got[0] == got[1]


@pytest.mark.parametrize("name", ["ledger", "double_count", "latest_survey_before_event", "units_in_boxes"])
def test_shuffled_joins_give_the_same(spark, conf, name):
    want = rows(REGISTRY[name].run(spark, SMALL))
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    assert rows(REGISTRY[name].run(spark, SMALL)) == want


def test_input_order_does_not_matter(spark):
    t = LandTables(spark, SMALL)
    want = rows(land.dominant_land_use(t.land_obs))
    shuffled = t.land_obs.repartition(5, F.xxhash64("provider_id", "area_ha")).sortWithinPartitions(F.desc("area_ha"))
    assert rows(land.dominant_land_use(shuffled)) == want


def test_totals_agree(spark):
    entries = inputs.placed_core(LandTables(spark, SMALL))
    total = entries.agg(F.sum("amount")).first()[0]
    rolled = report.report_rollup(entries, ["region_id", "year"]).filter("level = 3").first().amount
    gross = fluxes.gross_and_net(entries, ["gas"]).first()
    assert rolled == total == gross.net == gross.removals - gross.emissions


def test_every_unit_year_has_one_state(spark):
    st = inputs.state(LandTables(spark, SMALL))
    assert st.count() == st.select("unit_id", "year").distinct().count()
    assert st.groupBy("unit_id").count().select("count").distinct().collect()[0][0] == 7


def test_spells_cover_the_years(spark):
    st = inputs.state(LandTables(spark, SMALL))
    spells = land.land_use_spells(st)
    assert spells.agg(F.sum("n_years")).first()[0] == st.filter("land_use is not null").count()


def test_legacy_years_never_overlap(spark):
    t = LandTables(spark, SMALL)
    soil = fluxes.soil_mineral(inputs.state(t), t.land_unit, t.factor, until=2001)
    assert soil.groupBy("unit_id", "year").count().filter("count > 1").count() == 0


def test_draws_are_uniform_and_repeatable(spark):
    df = spark.range(20_000).select(uniform_draw(F.lit("s"), F.col("id").cast("string")).alias("u"))
    stats = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.var_pop("u")).first()
    assert 0 < stats[0] < 0.001 and 0.999 < stats[1] < 1
    assert stats[2] == pytest.approx(0.5, abs=0.01) and stats[3] == pytest.approx(1 / 12, abs=0.002)


def test_monte_carlo_agrees_with_the_formula(spark):
    parts = spark.createDataFrame(
        [("a", k, 100.0 * (i + 1), 0.2 + 0.1 * i) for i, k in enumerate(["x", "y", "z"])],
        "region string, factor_key string, amount double, rel_unc double",
    ).withColumn("amount", F.col("amount").cast("decimal(18,4)"))
    drawn = uncertainty.monte_carlo(parts, ["region"], 4000, seed=7).first()
    formula = uncertainty.propagate_sum(parts, ["region"]).first()
    assert drawn.sd == pytest.approx(formula.rel_unc * float(formula.amount), rel=0.05)
    assert drawn.mean == pytest.approx(600, rel=0.02) and drawn.p025 < drawn.p500 < drawn.p975
