"""Tables most queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landflux.operators import fluxes, land, prepare, report
from landflux.session import keep
from landflux.sources.tables import LandTables


def state(t: LandTables) -> DataFrame:
    return prepare.densify_years(land.dominant_land_use(t.land_obs), *t.years)


def survey_days(t: LandTables) -> DataFrame:
    """One survey per unit and day."""
    return prepare.latest_per_key(t.stock_obs, ["unit_id", "survey_date"], [F.desc("plot_obs_id")])


def harvest(t: LandTables) -> DataFrame:
    return fluxes.harvest_carbon(t.disturbance, t.land_unit, t.factor)


def core_ledger(t: LandTables) -> DataFrame:
    """Growth, harvest and conversion: the ledger the reports are shown on."""
    st = state(t)
    return fluxes.ledger(
        fluxes.biomass_gain(st, t.land_unit, t.factor),
        fluxes.harvest_loss(t.disturbance, t.land_unit, t.factor),
        fluxes.conversion_biomass(st, t.land_unit, t.factor),
    )


def placed_core(t: LandTables) -> DataFrame:
    return report.with_region(core_ledger(t), t.land_unit, t.country)


def placed_ledger(t: LandTables) -> DataFrame:
    """The core ledger and all gases of fires, in CO2-equivalent, with places: what reports run on."""
    st = state(t)
    parts = fluxes.ledger(
        core_ledger(t), fluxes.fire_fluxes(t.disturbance, st, t.land_unit, t.factor)
    )
    return report.with_region(fluxes.in_co2e(parts, t.gwp, "AR6"), t.land_unit, t.country)


def full_ledger(t: LandTables) -> DataFrame:
    """Every pool and gas, with both sides of each transfer.

    Conversions move biomass at once (``conversion_biomass``); response curves
    (``bookkeeping``) say the same another way and are never added to it.
    States, unit-years, changes and harvests are stored, as several parts read each.
    """
    st, cut = keep(state(t), "states"), keep(harvest(t), "harvests")
    years = keep(fluxes.unit_years(st, t.land_unit), "unit-years")
    changed = keep(fluxes.unit_changes(st, t.land_unit), "changes")
    return fluxes.ledger(
        fluxes.biomass_gain(years, t.land_unit, t.factor),
        fluxes.harvest_loss(cut, t.land_unit, t.factor),
        fluxes.harvest_gains(cut),
        fluxes.product_decay(cut, until=t.years[1]),
        fluxes.delayed_decay(cut, until=t.years[1]),
        fluxes.fire_fluxes(t.disturbance, years, t.land_unit, t.factor),
        fluxes.conversion_biomass(changed, t.land_unit, t.factor),
        fluxes.dom_conversion(changed, t.land_unit, t.factor, period=4, until=t.years[1]),
        fluxes.soil_mineral(changed, t.land_unit, t.factor, until=t.years[1]),
        fluxes.soil_organic(years, t.land_unit, t.factor),
        fluxes.soil_n2o_direct(t.n_input, years, t.land_unit, t.factor),
        fluxes.rewetting_ch4(st, t.land_unit, t.factor),
    )


def event_rules() -> dict[str, Column]:
    return {
        "severity below one": F.col("severity") < 0.95,
        "volume at least five": F.col("volume_m3") >= 5,
        "harvest or fire": F.col("kind").isin("harvest", "fire"),
    }
