"""Shared subqueries of the SQL checks, written apart from the Spark operators."""

from __future__ import annotations

from landflux.sources import literals
from landflux.sources.tables import TYPE_TO_USE

# first and last year of the observations
Y0, Y1 = "(SELECT y0 FROM span)", "(SELECT y1 FROM span)"
YEARS = "(SELECT unnest(range(y0, y1 + 1)) AS year FROM span)"


def amt(expr: str) -> str:
    return f"CAST(floor(({expr}) * 1e4 + 0.5) / 1e4 AS DECIMAL(18,4))"


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return f"'{v}'"
    return f"{v!r}e0" if isinstance(v, float) else str(v)


def values(rows: list[tuple], columns: str) -> str:
    text = ", ".join("(" + ", ".join(_value(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {text}) AS v({columns})"


def fx(param: str, use: str = "b.land_use", take: str = "value", row: str = "b") -> str:
    """The factor in force for one row: lowest tier, then latest start."""
    return (
        f"(SELECT arg_min(f.{take}, f.tier * 100000 - coalesce(f.valid_from, -9999)) FROM factor f "
        f"WHERE f.param = '{param}' AND {row}.year >= coalesce(f.valid_from, -9999) "
        f"AND {row}.year <= coalesce(f.valid_to, 99999) "
        f"AND (f.country_id IS NULL OR f.country_id = {row}.country_id) "
        f"AND (f.zone IS NULL OR f.zone = {row}.zone) "
        f"AND (f.land_use IS NULL OR f.land_use = {use}))"
    )


def entry(pool: str, process: str, gas: str, expr: str, source: str, unit: str = "tC") -> str:
    return (
        f"SELECT unit_id, year, '{pool}' AS pool, '{process}' AS process, '{gas}' AS gas, "
        f"{amt(expr)} AS amount, '{unit}' AS unit FROM {source} WHERE ({expr}) IS NOT NULL"
    )


def both(first: str, second: str) -> str:
    return f"{first} UNION ALL {second}"


_USE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_TO_USE.items())

SHARED: dict[str, str] = {}

SHARED["factor"] = (
    "SELECT *, CASE WHEN country_id IS NOT NULL THEN CASE WHEN zone IS NOT NULL THEN "
    "CASE WHEN land_use IS NOT NULL THEN 1 ELSE 2 END WHEN land_use IS NOT NULL THEN 3 ELSE 5 END "
    "WHEN zone IS NOT NULL THEN CASE WHEN land_use IS NOT NULL THEN 4 ELSE 6 END "
    "WHEN land_use IS NOT NULL THEN 7 ELSE 8 END AS tier FROM ("
    + values(
        literals.FACTOR_ROWS,
        "param, country_id, zone, land_use, valid_from, valid_to, value, unit, rel_unc",
    )
    + ")"
)
SHARED["gwp"] = values(literals.GWP_ROWS, "gwp_set, gas, value")
SHARED["curves"] = values(literals.curve_rows(), "from_use, to_use, age, share, pool")
SHARED["boxes"] = values(literals.BOX_ROWS, "box_id, lon0, lon1, lat0, lat1")
SHARED["country_dim"] = """
    SELECT n_nationkey AS country_id, n_name AS country, r_regionkey AS region_id, r_name AS region
    FROM nation JOIN region ON n_regionkey = r_regionkey"""
SHARED["land_unit"] = """
    SELECT c_custkey AS unit_id, c_nationkey AS country_id, c_mktsegment AS zone,
           CAST(10 + c_custkey % 91 AS DECIMAL(18,4)) AS area_ha,
           CAST(10 + c_custkey % 91 AS DOUBLE) AS area,
           ((c_custkey * 37) % 3600) / 10e0 - 180 AS lon,
           ((c_custkey * 53) % 1400) / 10e0 - 60 AS lat
    FROM customer"""
SHARED["place"] = """
    SELECT unit_id, zone, country_id, country, region_id, region
    FROM land_unit JOIN country_dim USING (country_id)"""
SHARED["land_obs"] = f"""
    SELECT o_custkey AS unit_id, CAST(l_shipdate AS DATE) AS obs_date, year(l_shipdate) AS year,
           CASE p_type {_USE} END AS land_use, CAST(l_quantity AS DECIMAL(18,4)) AS area_ha,
           l_suppkey AS provider_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
SHARED["span"] = "SELECT min(year) AS y0, max(year) AS y1 FROM land_obs"
SHARED["stock_obs"] = """
    SELECT o_orderkey AS plot_obs_id, o_custkey AS unit_id, CAST(o_orderdate AS DATE) AS survey_date,
           o_totalprice / 1000 AS c_density, o_orderstatus AS status FROM orders"""
SHARED["survey_day"] = """
    SELECT * FROM stock_obs
    QUALIFY row_number() OVER (PARTITION BY unit_id, survey_date ORDER BY plot_obs_id DESC) = 1"""
SHARED["disturbance"] = """
    SELECT o_custkey AS unit_id, CAST(l_shipdate AS DATE) AS event_date, year(l_shipdate) AS year,
           CASE l_returnflag WHEN 'R' THEN 'harvest' ELSE 'fire' END AS kind,
           l_discount * 10 AS severity, CAST(l_quantity AS DECIMAL(18,4)) AS volume_m3
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A')"""
SHARED["claim"] = """
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id,
           o_custkey AS unit_id, CASE l_returnflag WHEN 'R' THEN 'harvest' ELSE 'fire' END AS kind,
           CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) + 30 AS end_date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A')"""
SHARED["n_input"] = """
    SELECT o_custkey AS unit_id, year(l_shipdate) AS year,
           sum(CAST(l_quantity / 100 AS DECIMAL(18,4))) AS n_tonnes
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' GROUP BY ALL"""
SHARED["dominant"] = """
    SELECT unit_id, year, land_use, sum(area_ha) AS area_ha FROM land_obs
    GROUP BY unit_id, year, land_use QUALIFY row_number() OVER (PARTITION BY unit_id, year ORDER BY sum(area_ha) DESC, land_use) = 1"""
SHARED["state"] = f"""
    SELECT g.unit_id, g.year, d.land_use IS NOT NULL AS observed,
           last_value(d.land_use IGNORE NULLS) OVER (PARTITION BY g.unit_id ORDER BY g.year) AS land_use
    FROM (SELECT unit_id, year FROM (SELECT DISTINCT unit_id FROM dominant),
          {YEARS}) g
    LEFT JOIN dominant d ON g.unit_id = d.unit_id AND g.year = d.year"""
SHARED["trans"] = """
    SELECT * FROM (
        SELECT unit_id, year, lag(year) OVER w AS year_from, lag(land_use) OVER w AS use_from,
               land_use AS use_to
        FROM state WHERE land_use IS NOT NULL WINDOW w AS (PARTITION BY unit_id ORDER BY year))
    WHERE use_from IS NOT NULL"""
SHARED["chg"] = """
    SELECT t.*, lead(t.year) OVER (PARTITION BY t.unit_id ORDER BY t.year) AS next_change,
           country_id, zone, area
    FROM trans t JOIN land_unit USING (unit_id) WHERE use_from <> use_to"""
SHARED["spells"] = """
    SELECT unit_id, land_use, spell, min(year) AS first_year, max(year) AS last_year,
           max(year) - min(year) + 1 AS n_years
    FROM (SELECT *, sum(is_new) OVER (PARTITION BY unit_id ORDER BY year) AS spell FROM (
            SELECT unit_id, year, land_use,
                   CASE WHEN lag(land_use) OVER (PARTITION BY unit_id ORDER BY year) = land_use
                        THEN 0 ELSE 1 END AS is_new
            FROM state WHERE land_use IS NOT NULL))
    GROUP BY unit_id, land_use, spell"""
SHARED["uy"] = """
    SELECT unit_id, year, land_use, country_id, zone, area
    FROM state JOIN land_unit USING (unit_id) WHERE land_use IS NOT NULL"""
SHARED["gain_f"] = (
    f"SELECT b.*, {fx('growth')} AS growth, {fx('root_ratio')} AS root_ratio, "
    f"{fx('carbon_fraction')} AS cf FROM uy b"
)
SHARED["gain"] = both(
    entry("AGB", "growth", "CO2", "area * growth * cf", "gain_f"),
    entry("BGB", "growth", "CO2", "area * growth * cf * root_ratio", "gain_f"),
)
SHARED["cut"] = """
    SELECT d.unit_id, d.year, CAST(sum(volume_m3) AS DOUBLE) AS volume, country_id, zone,
           'forest' AS land_use
    FROM disturbance d JOIN land_unit USING (unit_id) WHERE kind = 'harvest' GROUP BY ALL"""
SHARED["harvest_f"] = (
    f"SELECT b.*, volume * {fx('expansion')} * {fx('carbon_fraction')} AS carbon, "
    f"{fx('root_ratio')} AS root_ratio, {fx('product_share')} AS product_share, "
    f"{fx('product_decay')} AS product_decay, {fx('debris_share')} AS debris_share, "
    f"{fx('debris_years')} AS debris_years FROM cut b"
)
SHARED["harvest"] = both(
    entry("AGB", "harvest", "CO2", "-carbon", "harvest_f"),
    entry("BGB", "harvest", "CO2", "-carbon * root_ratio", "harvest_f"),
)
SHARED["burn"] = """
    SELECT uy.*, severity FROM uy JOIN (
        SELECT unit_id, year, least(CAST(sum(CAST(severity AS DECIMAL(18,4))) AS DOUBLE), 1) AS severity
        FROM disturbance WHERE kind = 'fire' GROUP BY unit_id, year) USING (unit_id, year)"""
SHARED["burn_f"] = (
    f"SELECT b.*, {fx('biomass')} AS biomass, {fx('root_ratio')} AS root_ratio, {fx('fuel')} AS fuel, "
    f"{fx('combustion')} AS combustion, {fx('fire_CH4')} AS ch4, {fx('fire_N2O')} AS n2o FROM burn b"
)
SHARED["fire"] = both(
    entry("AGB", "fire", "CO2", "-(area * biomass * severity)", "burn_f"),
    entry("BGB", "fire", "CO2", "-(area * biomass * severity) * root_ratio", "burn_f"),
)
SHARED["fire_gas"] = both(
    entry("AGB", "fire", "CH4", "-(area * severity * fuel * combustion * ch4 * 0.001e0)", "burn_f", "t gas"),
    entry("AGB", "fire", "N2O", "-(area * severity * fuel * combustion * n2o * 0.001e0)", "burn_f", "t gas"),
)
SHARED["conv_f"] = (
    f"SELECT b.*, {fx('biomass', 'b.use_to')} AS b_to, {fx('biomass', 'b.use_from')} AS b_from, "
    f"{fx('root_ratio', 'b.use_to')} AS r_to, {fx('root_ratio', 'b.use_from')} AS r_from FROM chg b"
)
SHARED["conv"] = both(
    entry("AGB", "conversion", "CO2", "(b_to - b_from) * area", "conv_f"),
    entry("BGB", "conversion", "CO2", "(b_to * r_to - b_from * r_from) * area", "conv_f"),
)
SHARED["core"] = "SELECT * FROM gain UNION ALL SELECT * FROM harvest UNION ALL SELECT * FROM conv"
SHARED["core_placed"] = (
    "SELECT core.*, zone, country_id, country, region_id, region FROM core JOIN place USING (unit_id)"
)
# reports: carbon and gases of one ledger in tonnes of CO2-equivalent, gains positive
SHARED["fl"] = f"""
    SELECT unit_id, year, pool, process, gas,
           {amt("CAST(amount AS DOUBLE) * CASE WHEN gas = 'CO2' THEN 44e0 / 12e0 ELSE 1e0 END * value")} AS amount,
           zone, country_id, country, region_id, region
    FROM (SELECT * FROM core UNION ALL SELECT * FROM fire UNION ALL SELECT * FROM fire_gas)
    JOIN (SELECT * FROM gwp WHERE gwp_set = 'AR6') USING (gas) JOIN place USING (unit_id)"""
SHARED["readings"] = """
    SELECT event_id AS reading_id, user_id AS tower_id, ts, event_type AS kind,
           CASE WHEN event_type IN ('view', 'click') THEN -value ELSE value END AS flux,
           CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) * 0.4e0 AS temp_c
    FROM events"""
SHARED["fit"] = """
    SELECT tower_id, count(*) AS n, regr_intercept(ln(flux), temp_c) AS a,
           regr_slope(ln(flux), temp_c) AS b, exp(regr_slope(ln(flux), temp_c) * 10) AS q10
    FROM readings WHERE flux > 0 GROUP BY tower_id"""
SHARED["half_hours"] = """
    SELECT tower_id, time_bucket(INTERVAL 30 MINUTE, ts) AS start,
           time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n,
           sum(CAST(flux AS DECIMAL(18,4))) AS total_flux,
           CAST(sum(CAST(flux AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean_flux
    FROM readings GROUP BY ALL"""
