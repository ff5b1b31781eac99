"""Queries on sources, cleaning and shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from landflux.functions import (
    amount,
    fit_per_group,
    fit_rows,
    map_factor,
    response_curve_rows,
    saturating,
    to_unit,
    user_curve_rows,
)
from landflux.operators import factors, fluxes, land, prepare
from landflux.plans import inputs
from landflux.plans.registry import query
from landflux.session import run_dir
from landflux.sources import read_factors, read_ledger, write_ledger
from landflux.sources.schemas import FACTOR, POOLS


@query(
    "unit_id:i country_id:i zone:s area_ha:d lon:r6 lat:r6",
    "SELECT * FROM land_unit",
)
def land_units(t):
    return t.land_unit


@query(
    "unit_id:i obs_date:t land_use:s area_ha:d provider_id:i",
    "SELECT * FROM land_obs",
)
def land_observations(t):
    return t.land_obs


@query(
    "country_id:i status:s zone:s n_surveys:i mean_density:r6",
    """SELECT country_id, zone, status, count(*) AS n_surveys,
              CAST(sum(CAST(c_density AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS mean_density
       FROM stock_obs JOIN land_unit USING (unit_id) GROUP BY ALL""",
)
def surveys_by_country(t):
    density = F.sum(F.col("c_density").cast("decimal(18,6)")).cast("double")
    return (
        prepare.attach(t.stock_obs, t.land_unit, "unit_id")
        .groupBy("country_id", "zone", "status")
        .agg(F.count("*").alias("n_surveys"), (density / F.count("*")).alias("mean_density"))
    )


@query(
    "unit_id:i year:i density:r4 density_tier:i",
    """SELECT unit_id, 2000 AS year, density, 4 AS density_tier FROM land_unit JOIN (
         SELECT zone, floor(CAST(sum(CAST(c_density AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 1e4 + 0.5) / 1e4
                AS density
         FROM stock_obs JOIN land_unit USING (unit_id) GROUP BY zone) USING (zone)""",
)
def factors_from_file(t):
    """Mean survey density per zone, stored as a factor file, read back and looked up."""
    density = F.sum(F.col("c_density").cast("decimal(18,6)")).cast("double") / F.count("*")
    means = t.stock_obs.join(t.land_unit, "unit_id").groupBy("zone").agg(amount(density).alias("v"))
    rows = means.select(
        F.lit("density").alias("param"),
        F.lit(None).cast("int").alias("country_id"),
        "zone",
        F.lit("any").alias("land_use"),
        F.lit(1990).alias("valid_from"),
        F.lit(2050).alias("valid_to"),
        F.col("v").cast("double").alias("value"),
        F.lit("tC/ha").alias("unit"),
        F.lit(None).cast("double").alias("rel_unc"),
    )
    path = run_dir(t.spark, "factors")
    rows.select(*[c.split()[0] for c in FACTOR.split(", ")]).write.option("header", "true").csv(path)
    units = t.land_unit.withColumn("year", F.lit(2000)).withColumn("land_use", F.lit("any"))
    return factors.resolve_factor(units, read_factors(t.spark, path), "density")


@query(
    "year:i pool:s n_rows:i amount:d",
    "SELECT year, pool, count(*) AS n_rows, sum(amount) AS amount FROM gain GROUP BY ALL",
)
def ledger_store(t):
    """The growth ledger written by year, one year written again, and read back."""
    path = run_dir(t.spark, "ledger")
    gain = fluxes.biomass_gain(inputs.state(t), t.land_unit, t.factor)
    write_ledger(gain, path)
    write_ledger(gain.filter(F.col("year") == t.years[1]), path)
    stored = read_ledger(t.spark, path)
    return stored.groupBy("year", "pool").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount"))


@query(
    "unit_id:i event_date:t kind:s severity:r6 volume_m3:d",
    "SELECT * FROM disturbance WHERE severity < 0.95e0 AND volume_m3 >= 5",
)
def valid_events(t):
    return prepare.valid_rows(t.disturbance, inputs.event_rules())


@query(
    "unit_id:i event_date:t kind:s severity:r6 volume_m3:d broken:s",
    """SELECT *, concat_ws(';', CASE WHEN severity >= 0.95e0 THEN 'severity below one' END,
                                CASE WHEN volume_m3 < 5 THEN 'volume at least five' END) AS broken
       FROM disturbance WHERE severity >= 0.95e0 OR volume_m3 < 5""",
)
def rejected_events(t):
    return prepare.rejected_rows(t.disturbance, inputs.event_rules())


@query(
    "plot_obs_id:i unit_id:i survey_date:t c_density:r6 status:s",
    "SELECT * FROM survey_day",
)
def latest_survey_per_day(t):
    return inputs.survey_days(t)


@query(
    "unit_id:i plot_obs_id:i co2_density:r6 area_m2:r4",
    """SELECT unit_id, plot_obs_id, c_density * (44e0 / 12e0) AS co2_density, area * 10000 AS area_m2
       FROM stock_obs JOIN land_unit USING (unit_id)""",
)
def converted_units(t):
    df = prepare.attach(t.stock_obs, t.land_unit, "unit_id")
    df = to_unit(df, "c_density", "C", "CO2", out="co2_density")
    return to_unit(df, "area_ha", "ha", "m2", out="area_m2")


@query(
    "unit_id:i country:s region:s zone:s area_ha:d",
    "SELECT unit_id, country, region, land_unit.zone, area_ha FROM land_unit LEFT JOIN country_dim USING (country_id)",
)
def attached_country(t):
    return prepare.attach(t.land_unit, t.country, "country_id")


_WIDE = ", ".join(f"sum(amount) FILTER (WHERE pool = '{p}') AS {p}" for p in POOLS)


@query(
    "unit_id:i year:i " + " ".join(f"{p}:d" for p in POOLS),
    f"SELECT unit_id, year, {_WIDE} FROM core GROUP BY unit_id, year",
)
def pools_wide(t):
    return prepare.pools_wide(inputs.core_ledger(t), ["unit_id", "year"], POOLS)


@query(
    "unit_id:i year:i pool:s amount:d",
    f"""SELECT * FROM (SELECT unit_id, year, {_WIDE} FROM gain GROUP BY unit_id, year)
        UNPIVOT INCLUDE NULLS (amount FOR pool IN (AGB, BGB))""",
)
def pools_long(t):
    gain = fluxes.biomass_gain(inputs.state(t), t.land_unit, t.factor)
    wide = prepare.pools_wide(gain, ["unit_id", "year"], ["AGB", "BGB"])
    return prepare.pools_long(wide, ["unit_id", "year"], ["AGB", "BGB"])


@query("unit_id:i year:i land_use:s observed:b", "SELECT * FROM state")
def densified_years(t):
    return inputs.state(t)


@query(
    "cell_x:i cell_y:i n_units:i total_area_ha:d mean_value:r6 cell_km2:r4",
    """SELECT CAST(floor(lon / 10e0) AS INTEGER) AS cell_x, CAST(floor(lat / 10e0) AS INTEGER) AS cell_y,
              count(*) AS n_units, sum(area_ha) AS total_area_ha,
              CAST(sum(CAST(area * c_density AS DECIMAL(28,6))) AS DOUBLE) / CAST(sum(area_ha) AS DOUBLE)
                AS mean_value,
              1113.2e0 * 1113.2e0 * cos(radians((floor(lat / 10e0) + 0.5) * 10)) AS cell_km2
       FROM land_unit JOIN (SELECT * FROM stock_obs QUALIFY row_number() OVER (
              PARTITION BY unit_id ORDER BY survey_date DESC, plot_obs_id DESC) = 1) USING (unit_id)
       GROUP BY ALL""",
)
def carbon_grid(t):
    last = prepare.latest_per_key(
        t.stock_obs, ["unit_id"], [F.desc("survey_date"), F.desc("plot_obs_id")]
    )
    return prepare.grid_aggregate(t.land_unit.join(last, "unit_id"), 10.0, "c_density")


@query(
    "unit_id:i box_id:i",
    """SELECT unit_id, box_id FROM land_unit JOIN boxes
       ON lon >= lon0 AND lon < lon1 AND lat >= lat0 AND lat < lat1""",
)
def units_in_boxes(t):
    return prepare.zones_of_points(t.land_unit, t.boxes)


@query(
    "unit_id:i n_years:i slope:r4",
    """SELECT unit_id, count(DISTINCT year(survey_date)) AS n_years,
              CASE WHEN count(DISTINCT year(survey_date)) = 1 THEN 0
                   ELSE regr_slope(c_density, year(survey_date)) END AS slope
       FROM stock_obs GROUP BY unit_id""",
)
def fitted_growth(t):
    """A user's weighted line through the yearly mean density of each unit."""

    def line(x, y, n, _):
        mx, my = (n * x).sum() / n.sum(), (n * y).sum() / n.sum()
        sxx = (n * (x - mx) ** 2).sum()
        return len(x), (n * (x - mx) * (y - my)).sum() / sxx if sxx else 0.0

    surveys = t.stock_obs.withColumn("year", F.year("survey_date"))
    schema = "n_years bigint, slope double"
    return fit_per_group(surveys, ["unit_id"], "year", "c_density", line, schema)


@query(
    "zone:s n:i level:r1 speed:r3 converged:b",
    """SELECT zone, count(*) AS n, 50 + 10 * length(zone) AS level, 0.05 + 0.01 * (length(zone) % 4) AS speed,
              true AS converged FROM stock_obs JOIN land_unit USING (unit_id) GROUP BY zone""",
)
def saturating_growth(t):
    """Curves found again: growth of known level and speed in each zone, at the age of every survey."""
    surveys = t.stock_obs.join(t.land_unit.select("unit_id", "zone"), "unit_id")
    age = F.datediff("survey_date", F.lit("1990-01-01").cast("date")) / 365.25
    level, speed = 50 + 10 * F.length("zone"), 0.05 + 0.01 * (F.length("zone") % 4)
    grown = surveys.select("zone", age.alias("age"), (level * (1 - F.exp(-speed * age))).alias("density"))
    fitted = fit_rows(grown, ["zone"], "density", saturating("age"), {"a": F.max("density"), "b": F.lit(0.2)})
    return fitted.withColumnsRenamed({"a": "level", "b": "speed"})


@query(
    "plot_obs_id:i unit_id:i saturated:r6",
    "SELECT plot_obs_id, unit_id, 300 * (1 - exp(-c_density / 300)) AS saturated FROM stock_obs",
)
def mapped_density(t):
    def saturate(values):
        import numpy as np

        return 300.0 * (1.0 - np.exp(-values / 300.0))

    return map_factor(t.stock_obs, "c_density", saturate, "saturated")


@query(
    "use_from:s use_to:s age:i share:r3",
    """WITH p AS (SELECT use_from, use_to, CAST(sum(area_ha) AS DOUBLE) / count(*) AS total
                  FROM trans JOIN land_unit USING (unit_id) WHERE use_from <> use_to GROUP BY ALL)
       SELECT use_from, use_to, age,
              CASE WHEN age = 4 THEN total * pow(0.75e0, 4) ELSE total * 0.25e0 * pow(0.75e0, age) END AS share
       FROM p, (SELECT unnest(range(5)) AS age)""",
)
def response_curves(t):
    """Curves that end by a constant rate, from the mean area of each change."""
    return response_curve_rows(_curve_params(t), "total", "rate", "years")


def _curve_params(t):
    pairs = land.transition_matrix(inputs.state(t), t.land_unit).filter("use_from <> use_to")
    return pairs.select(
        "use_from",
        "use_to",
        (F.col("area_ha").cast("double") / F.col("n_units")).alias("total"),
        F.lit(0.25).alias("rate"),
        F.lit(5).alias("years"),
    )


@query(
    "use_from:s use_to:s age:i share:r3",
    """WITH p AS (SELECT use_from, use_to, CAST(sum(area_ha) AS DOUBLE) / count(*) AS total
                  FROM trans JOIN land_unit USING (unit_id) WHERE use_from <> use_to GROUP BY ALL)
       SELECT use_from, use_to, age, total / 5 AS share FROM p, (SELECT unnest(range(5)) AS age)""",
)
def user_curves(t):
    """Curves of a user's table function: equal steps."""

    def steps(total, years):
        for age in range(years):
            yield age, total / years

    return user_curve_rows(_curve_params(t), steps, ["total", "years"])
