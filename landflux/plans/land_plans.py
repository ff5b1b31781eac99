"""Queries on land representation and factor resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from landflux.operators import checks, factors, fluxes, land
from landflux.plans import inputs
from landflux.plans.check_sql import YEARS, fx
from landflux.plans.registry import query


def slice_states(t):
    """Observed states only, with the observed area of the class."""
    return land.dominant_land_use(t.land_obs)


_SLICE = "CASE {} " + " ".join(
    f"WHEN '{use}' THEN {c}"
    for use, c in [("forest", 120), ("cropland", 5), ("grassland", 8), ("wetland", 20), ("settlement", 3)]
) + " ELSE 0 END"


@query(
    "region_id:i year:i n_pairs:i change:d",
    f"""SELECT region_id, year, count(*) AS n_pairs,
               sum(area_ha * ({_SLICE.format('use_to')} - {_SLICE.format('use_from')})) AS change
        FROM (SELECT unit_id, year, area_ha, land_use AS use_to,
                     lag(land_use) OVER (PARTITION BY unit_id ORDER BY year) AS use_from FROM dominant)
        JOIN place USING (unit_id) WHERE use_from IS NOT NULL GROUP BY ALL""",
)
def conversion_by_region(t):
    """Change of biomass carbon by conversion, per region and year."""
    pairs = land.transitions(slice_states(t)).join(
        t.land_unit.join(t.country, "country_id").select("unit_id", "region_id"), "unit_id"
    )
    everywhere = t.factor.filter("zone is null")
    names = {"biomass": "after"}
    df = factors.resolve_factors(pairs, everywhere, ["biomass"], land_use="use_to", names=names)
    df = factors.resolve_factors(
        df, everywhere, ["biomass"], land_use="use_from", names={"biomass": "before"}
    )
    density = (F.col("after") - F.col("before")).cast("decimal(9,4)")
    return df.groupBy("region_id", "year").agg(
        F.count("*").alias("n_pairs"), F.sum(F.col("area_ha") * density).alias("change")
    )


@query("unit_id:i year:i land_use:s area_ha:d", "SELECT * FROM dominant")
def dominant_land_use(t):
    return land.dominant_land_use(t.land_obs)


@query("unit_id:i year_from:i year:i use_from:s use_to:s", "SELECT * FROM trans")
def transitions(t):
    return land.transitions(inputs.state(t))


@query(
    "year:i region_id:i use_from:s use_to:s area_ha:d n_units:i",
    """SELECT year, region_id, use_from, use_to, sum(area_ha) AS area_ha, count(*) AS n_units
       FROM trans JOIN land_unit USING (unit_id) JOIN country_dim USING (country_id) GROUP BY ALL""",
)
def transition_matrix(t):
    units = t.land_unit.join(t.country, "country_id")
    return land.transition_matrix(inputs.state(t), units, ["year", "region_id"])


@query("unit_id:i land_use:s spell:i first_year:i last_year:i n_years:i", "SELECT * FROM spells")
def land_use_spells(t):
    return land.land_use_spells(inputs.state(t))


@query(
    "unit_id:i year:i land_use:s use_from:s category:s",
    """SELECT s.unit_id, s.year, s.land_use,
              CASE WHEN recent THEN c.use_from ELSE s.land_use END AS use_from,
              CASE WHEN recent THEN 'land converted to ' || s.land_use
                   ELSE s.land_use || ' remaining ' || s.land_use END AS category
       FROM (SELECT uy.*, (SELECT max(chg.year) FROM chg
                           WHERE chg.unit_id = uy.unit_id AND chg.year <= uy.year) AS since FROM uy) s
       LEFT JOIN chg c ON c.unit_id = s.unit_id AND c.year = s.since,
       LATERAL (SELECT coalesce(s.year - s.since < 3, false) AS recent)""",
)
def remaining_or_converted(t):
    return land.remaining_or_converted(inputs.state(t), period=3)


@query(
    "unit_id:i loss_year:i use_to:s",
    """SELECT unit_id, min(year) AS loss_year, arg_min(use_to, year) AS use_to FROM trans
       WHERE use_from = 'forest' AND use_to <> 'forest' GROUP BY unit_id""",
)
def first_forest_loss(t):
    return land.first_loss_year(inputs.state(t), "forest")


@query(
    "unit_id:i land_use:s left_year:i back_year:i years_away:i",
    """SELECT a.unit_id, a.land_use, a.last_year + 1 AS left_year, b.first_year AS back_year,
              b.first_year - a.last_year - 1 AS years_away
       FROM spells a JOIN spells b ON a.unit_id = b.unit_id AND a.land_use = b.land_use
            AND b.spell > a.spell
       WHERE b.first_year - a.last_year - 1 <= 3 AND NOT EXISTS (
            SELECT 1 FROM spells c WHERE c.unit_id = a.unit_id AND c.land_use = a.land_use
            AND c.spell > a.spell AND c.spell < b.spell)""",
)
def return_transitions(t):
    return land.return_transitions(inputs.state(t), within=3)


_NAMED = """SELECT unit_id, year, provider_id, land_use FROM land_obs
    GROUP BY unit_id, year, provider_id, land_use QUALIFY row_number() OVER (PARTITION BY unit_id, year, provider_id
                               ORDER BY sum(area_ha) DESC, land_use) = 1"""


@query(
    "year:i use_a:s use_b:s pairs:i",
    f"""WITH named AS ({_NAMED})
        SELECT a.year, least(a.land_use, b.land_use) AS use_a, greatest(a.land_use, b.land_use) AS use_b,
               count(*) AS pairs
        FROM named a JOIN named b ON a.unit_id = b.unit_id AND a.year = b.year
             AND a.provider_id < b.provider_id GROUP BY ALL""",
)
def provider_confusion(t):
    return land.provider_confusion(t.land_obs)


@query(
    "provider_id:i compared:i agreed:i agreement:r6",
    f"""WITH named AS ({_NAMED})
        SELECT n.provider_id, count(b.provider_id) AS compared,
               count(b.provider_id) FILTER (WHERE n.land_use = b.land_use) AS agreed,
               count(b.provider_id) FILTER (WHERE n.land_use = b.land_use)
                 / nullif(CAST(count(b.provider_id) AS DOUBLE), 0) AS agreement
        FROM named n LEFT JOIN named b ON n.unit_id = b.unit_id AND n.year = b.year
             AND n.provider_id <> b.provider_id GROUP BY n.provider_id""",
)
def provider_agreement(t):
    return land.provider_agreement(t.land_obs)


@query(
    "unit_id:i year:i growth:r6 growth_tier:i growth_unc:r6",
    f"""SELECT unit_id, year, {fx('growth')} AS growth, {fx('growth', take='tier')} AS growth_tier,
               {fx('growth', take='rel_unc')} AS growth_unc FROM uy b""",
)
def resolved_factor(t):
    df = fluxes.unit_years(inputs.state(t), t.land_unit)
    return factors.resolve_factor(df, t.factor, "growth")


# unit-years far from the observed ones
_FAR = "SELECT * REPLACE (year + shift AS year) FROM uy, (SELECT unnest([-160, 0, 90]) AS shift)"


@query(
    "unit_id:i year:i land_use:s growth:r6 growth_tier:i growth_unc:r6 root_ratio:r6",
    f"""SELECT unit_id, year, land_use, {fx('growth')} AS growth, {fx('growth', take='tier')} AS growth_tier,
               {fx('growth', take='rel_unc')} AS growth_unc, {fx('root_ratio')} AS root_ratio FROM ({_FAR}) b""",
)
def factor_scopes(t):
    """Factors of every scope, in years long before and after the land was observed."""
    df = fluxes.unit_years(inputs.state(t), t.land_unit)
    far = df.withColumn("year", F.explode(F.array(*[F.col("year") + shift for shift in (-160, 0, 90)])))
    found = factors.resolve_factor(far, t.factor, "growth")
    return factors.resolve_factors(found, t.factor, ["root_ratio"])


@query(
    "unit_id:i year:i land_use:s n2o_direct:r6",
    """SELECT unit_id, year, land_use, (SELECT arg_max(f.value, f.valid_from) FROM factor f
              WHERE f.param = 'n2o_direct' AND f.country_id IS NULL AND f.zone IS NULL
              AND f.land_use = b.land_use AND b.year >= coalesce(valid_from, -9999)
              AND b.year <= coalesce(valid_to, 99999)) AS n2o_direct
       FROM state b""",
)
def factor_in_force(t):
    return factors.factor_in_force(inputs.state(t), t.factor, "n2o_direct")


@query(
    "unit_id:i event_date:t kind:s volume_m3:d survey_date:t plot_obs_id:i c_density:r6",
    """SELECT d.unit_id, event_date, kind, volume_m3, survey_date, plot_obs_id, c_density
       FROM disturbance d ASOF LEFT JOIN survey_day s
            ON d.unit_id = s.unit_id AND d.event_date >= s.survey_date""",
)
def latest_survey_before_event(t):
    return factors.latest_before(
        t.disturbance,
        t.stock_obs,
        "unit_id",
        "event_date",
        "survey_date",
        ["plot_obs_id", "c_density"],
        [F.desc("plot_obs_id")],
    )


@query(
    "country_id:i zone:s land_use:s year:i n_rows:i",
    f"""SELECT country_id, zone, land_use, year, count(*) AS n_rows FROM uy b
        WHERE {fx('rewetting_CH4')} IS NULL GROUP BY ALL""",
)
def missing_factors(t):
    df = fluxes.unit_years(inputs.state(t), t.land_unit)
    return factors.missing_factors(df, t.factor, "rewetting_CH4")


@query(
    "year:i classified_ha:d unobserved_ha:d n_doubled:i n_unobserved:i n_foreign:i missing_ha:d balanced:b",
    """SELECT year, coalesce(sum(area_ha) FILTER (WHERE land_use IS NOT NULL), 0) AS classified_ha,
              coalesce(sum(area_ha) FILTER (WHERE land_use IS NULL), 0) AS unobserved_ha,
              0 AS n_doubled, count(*) FILTER (WHERE land_use IS NULL) AS n_unobserved, 0 AS n_foreign,
              (SELECT sum(area_ha) FROM land_unit) - sum(area_ha) AS missing_ha,
              (SELECT sum(area_ha) FROM land_unit) = sum(area_ha) AS balanced
       FROM state JOIN land_unit USING (unit_id) GROUP BY year""",
)
def all_land_check(t):
    return checks.all_land_check(inputs.state(t), t.land_unit)


@query(
    "unit_id:i year:i reason:s",
    f"""SELECT unit_id, year, 'not yet observed' AS reason FROM state WHERE land_use IS NULL
        UNION ALL SELECT unit_id, year, 'never observed' FROM land_unit, {YEARS} y
        WHERE unit_id NOT IN (SELECT unit_id FROM state)""",
)
def units_without_class(t):
    return checks.units_without_class(inputs.state(t), t.land_unit, *t.years)
