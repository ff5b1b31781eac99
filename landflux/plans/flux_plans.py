"""Queries on stocks and fluxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from landflux.operators import checks, fluxes, stocks
from landflux.plans import inputs
from landflux.plans.check_sql import Y1, YEARS, amt, both, entry, fx
from landflux.plans.registry import REGISTRY, query

ROWS = "unit_id:i year:i pool:s process:s gas:s amount:d unit:s"
# years a change acts in, cut at the next change and at the last year
_ACTING = (
    f"SELECT c.*, y.year AS out_year FROM {{source}} c, {YEARS} y "
    "WHERE y.year >= c.year AND y.year < c.year + {period} AND y.year < coalesce(c.next_change, 9999)"
)


def _spread(source: str, period: int, parts: list[tuple[str, str]], process: str = "conversion") -> str:
    """Each change's yearly step, in every year it acts in."""
    acting = _ACTING.format(source=f"({source})", period=period)
    again = f"(SELECT * REPLACE (out_year AS year) FROM ({acting}))"
    return " UNION ALL ".join(entry(pool, process, "CO2", expr, again) for pool, expr in parts)


@query(ROWS, "SELECT * FROM gain")
def biomass_gain(t):
    return fluxes.biomass_gain(inputs.state(t), t.land_unit, t.factor)


@query(ROWS, "SELECT * FROM harvest")
def harvest_loss(t):
    return fluxes.harvest_loss(t.disturbance, t.land_unit, t.factor)


@query(ROWS, "SELECT * FROM fire")
def disturbance_loss(t):
    return fluxes.disturbance_loss(t.disturbance, inputs.state(t), t.land_unit, t.factor)


@query(
    "unit_id:i year:i pool:s gains:d losses:d net:d",
    """SELECT unit_id, year, pool, coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS gains,
              coalesce(-sum(amount) FILTER (WHERE amount < 0), 0) AS losses, sum(amount) AS net
       FROM core GROUP BY ALL""",
)
def gain_loss(t):
    return fluxes.gain_loss(inputs.core_ledger(t))


@query(
    "unit_id:i from_date:t to_date:t days:i amount:d",
    f"""SELECT unit_id, from_date, to_date, days,
               {amt('(c_density - c_before) / (days / 365.25e0) * area')} AS amount
        FROM (SELECT unit_id, survey_date AS to_date, c_density, lag(c_density) OVER w AS c_before,
                     lag(survey_date) OVER w AS from_date,
                     datediff('day', lag(survey_date) OVER w, survey_date) AS days
              FROM survey_day WINDOW w AS (PARTITION BY unit_id ORDER BY survey_date))
        JOIN land_unit USING (unit_id) WHERE from_date IS NOT NULL""",
)
def stock_difference(t):
    return fluxes.stock_difference(inputs.survey_days(t), t.land_unit)


@query(ROWS, "SELECT * FROM conv")
def conversion_biomass(t):
    return fluxes.conversion_biomass(inputs.state(t), t.land_unit, t.factor)


_DOM = (
    f"SELECT b.*, {fx('dead_wood', 'b.use_to')} - {fx('dead_wood', 'b.use_from')} AS dw, "
    f"{fx('litter', 'b.use_to')} - {fx('litter', 'b.use_from')} AS lt FROM chg b"
)


@query(ROWS, _spread(_DOM, 4, [("DW", "dw * area / 4e0"), ("LITTER", "lt * area / 4e0")]))
def dom_conversion(t):
    return fluxes.dom_conversion(inputs.state(t), t.land_unit, t.factor, period=4, until=t.years[1])


def _soc(use: str) -> str:
    return " * ".join(fx(p, use) for p in ("soc_ref", "soc_land_use", "soc_management", "soc_input"))


@query(
    ROWS,
    _spread(
        f"SELECT b.*, {_soc('b.use_to')} AS s_to, {_soc('b.use_from')} AS s_from FROM chg b",
        20,
        [("SOC", "(s_to - s_from) * area / 20e0")],
    ),
)
def soil_mineral(t):
    return fluxes.soil_mineral(inputs.state(t), t.land_unit, t.factor, until=t.years[1])


@query(
    ROWS,
    entry(
        "SOC",
        "drainage",
        "CO2",
        "-(area * share * ef)",
        f"(SELECT b.*, {fx('organic_share')} AS share, {fx('organic_drainage')} AS ef FROM uy b)",
    )
    + " AND ef > 0",
)
def soil_organic(t):
    return fluxes.soil_organic(inputs.state(t), t.land_unit, t.factor)


@query(ROWS, "SELECT * FROM fire_gas")
def fire_non_co2(t):
    return fluxes.fire_non_co2(t.disturbance, inputs.state(t), t.land_unit, t.factor)


@query(
    ROWS,
    entry(
        "SOC",
        "nitrogen",
        "N2O",
        "-(n * ef * (44e0 / 28e0))",
        f"""(SELECT b.*, {fx('n2o_direct')} AS ef FROM (
              SELECT uy.*, CAST(n_tonnes AS DOUBLE) AS n FROM uy JOIN n_input USING (unit_id, year)) b)""",
        "t gas",
    ),
)
def soil_n2o_direct(t):
    return fluxes.soil_n2o_direct(t.n_input, inputs.state(t), t.land_unit, t.factor)


@query(
    "country_id:i year:i stock:d change:d",
    f"""WITH inflow AS (
          SELECT country_id, year, product_decay AS k,
                 CAST(sum({amt('carbon * product_share')}) AS DOUBLE) AS c
          FROM harvest_f GROUP BY ALL),
        stocks AS (
          SELECT country_id, y.year, sum({amt('c * exp(-k * (y.year - i.year)) * (1 - exp(-k)) / k')}) AS stock
          FROM inflow i, {YEARS} y WHERE y.year >= i.year GROUP BY ALL)
        SELECT *, stock - coalesce(lag(stock) OVER (PARTITION BY country_id ORDER BY year), 0) AS change
        FROM stocks""",
)
def hwp_pool(t):
    return fluxes.hwp_pool(inputs.harvest(t), until=t.years[1])


@query(
    ROWS,
    entry(
        "SOC",
        "rewetting",
        "CH4",
        "-(area * share * ef)",
        f"""(SELECT b.*, {fx('organic_share')} AS share, {fx('rewetting_CH4')} AS ef FROM uy b
             WHERE land_use = 'wetland' AND EXISTS (
               SELECT 1 FROM uy e WHERE e.unit_id = b.unit_id AND e.year < b.year
               AND e.land_use <> 'wetland'))""",
        "t gas",
    ),
)
def rewetting_ch4(t):
    return fluxes.rewetting_ch4(inputs.state(t), t.land_unit, t.factor)


_DEBRIS = (
    "-(carbon * debris_share * (exp(-(y.year - h.year) / debris_years) "
    "- exp(-(y.year - h.year + 1) / debris_years)))"
)


@query(
    ROWS,
    f"""SELECT unit_id, y.year, 'DW' AS pool, 'decay' AS process, 'CO2' AS gas, 'tC' AS unit,
               sum({amt(_DEBRIS)}) AS amount
       FROM harvest_f h, {YEARS} y
       WHERE y.year >= h.year GROUP BY unit_id, y.year""",
)
def delayed_decay(t):
    return fluxes.delayed_decay(inputs.harvest(t), until=t.years[1])


@query(
    ROWS,
    f"""SELECT unit_id, c.year + v.age AS year, v.pool, 'legacy' AS process, 'CO2' AS gas, 'tC' AS unit,
               sum({amt('area * v.share')}) AS amount
        FROM chg c JOIN curves v ON c.use_from = v.from_use AND c.use_to = v.to_use
        WHERE c.year + v.age <= {Y1} AND c.year + v.age < coalesce(next_change, 9999) GROUP BY ALL""",
)
def bookkeeping(t):
    return fluxes.bookkeeping(inputs.state(t), t.land_unit, t.curves, until=t.years[1])


@query(ROWS, "SELECT * FROM core")
def ledger(t):
    return inputs.core_ledger(t)


@query(
    ROWS + " co2e:d",
    f"""SELECT l.*, {amt("-(CAST(amount AS DOUBLE) * CASE WHEN gas = 'CO2' THEN 44e0 / 12e0 ELSE 1e0 END * value)")}
               AS co2e
        FROM ({both('SELECT * FROM fire', 'SELECT * FROM fire_gas')}) l
        JOIN gwp USING (gas) WHERE gwp_set = 'AR6'""",
)
def fire_co2e(t):
    st = inputs.state(t)
    return fluxes.co2e(fluxes.fire_fluxes(t.disturbance, st, t.land_unit, t.factor), t.gwp, "AR6")


@query(
    "region_id:i year:i removals:d emissions:d net:d",
    """SELECT region_id, year, coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS removals,
              coalesce(-sum(amount) FILTER (WHERE amount < 0), 0) AS emissions, sum(amount) AS net
       FROM core_placed GROUP BY ALL""",
)
def gross_and_net(t):
    return fluxes.gross_and_net(inputs.placed_core(t), ["region_id", "year"])


_GAINS = both(
    entry("DW", "harvest", "CO2", "carbon * debris_share", "harvest_f"),
    entry("HWP", "harvest", "CO2", "carbon * product_share", "harvest_f"),
)


@query(ROWS, _GAINS)
def harvest_gains(t):
    return fluxes.harvest_gains(inputs.harvest(t))


_SINCE = "(y.year - h.year)"
_LEFT = "((1 - exp(-product_decay)) / product_decay)"
_PRODUCT_LOSS = (
    f"-(carbon * product_share * (CASE WHEN {_SINCE} = 0 THEN 1 - {_LEFT} ELSE {_LEFT} * "
    f"(exp(-product_decay * ({_SINCE} - 1)) - exp(-product_decay * {_SINCE})) END))"
)


@query(
    ROWS,
    f"""SELECT unit_id, y.year, 'HWP' AS pool, 'decay' AS process, 'CO2' AS gas, 'tC' AS unit,
               sum({amt(_PRODUCT_LOSS)}) AS amount
       FROM harvest_f h, {YEARS} y
       WHERE y.year >= h.year GROUP BY unit_id, y.year""",
)
def product_decay(t):
    return fluxes.product_decay(inputs.harvest(t), until=t.years[1])


_PARTS = [
    "biomass_gain", "harvest_loss", "harvest_gains", "product_decay", "delayed_decay", "disturbance_loss",
    "fire_non_co2", "conversion_biomass", "dom_conversion", "soil_mineral", "soil_organic", "soil_n2o_direct",
    "rewetting_ch4",
]
_COLUMNS = "unit_id, year, pool, process, gas, amount, unit"


@query(ROWS, " UNION ALL ".join(f"SELECT {_COLUMNS} FROM ({REGISTRY[p].body})" for p in _PARTS))
def full_ledger(t):
    return inputs.full_ledger(t)


_STOCKS = " UNION ALL ".join(
    f"""SELECT unit_id, y.year, '{pool}' AS pool, sum({amt(expr)}) AS stock
        FROM harvest_f h, {YEARS} y WHERE y.year >= h.year
        GROUP BY unit_id, y.year"""
    for pool, expr in (
        ("DW", f"carbon * debris_share * exp(-({_SINCE} + 1) / debris_years)"),
        ("HWP", f"carbon * product_share * exp(-product_decay * {_SINCE}) * {_LEFT}"),
    )
)


@query(
    "pool:s status:s n_rows:i",
    f"""WITH stocks AS ({_STOCKS}),
        moved AS (SELECT *, stock - lag(stock) OVER (PARTITION BY unit_id, pool ORDER BY year) AS stock_change
                  FROM stocks),
        flows AS (SELECT unit_id, year, pool, sum(amount) AS flux FROM (
                    SELECT {_COLUMNS} FROM ({_GAINS})
                    UNION ALL SELECT {_COLUMNS} FROM ({REGISTRY['product_decay'].body})
                    UNION ALL SELECT {_COLUMNS} FROM ({REGISTRY['delayed_decay'].body})) GROUP BY ALL),
        gaps AS (SELECT pool, flux, stock_change, coalesce(stock_change, 0) - coalesce(flux, 0) AS difference
                 FROM (SELECT * FROM moved WHERE stock_change IS NOT NULL) FULL JOIN flows USING (unit_id, year, pool))
        SELECT pool, CASE WHEN stock_change IS NULL THEN 'no stock' WHEN abs(difference) <= 0.01 THEN 'balanced'
                          WHEN flux IS NULL THEN 'no flux' ELSE 'off' END AS status, count(*) AS n_rows
        FROM gaps GROUP BY ALL""",
)
def transfer_check(t):
    """Debris and products: stocks by their own formula against the ledger's gains and losses."""
    cut = inputs.harvest(t)
    flows = fluxes.ledger(
        fluxes.harvest_gains(cut), fluxes.product_decay(cut, until=t.years[1]), fluxes.delayed_decay(cut, until=t.years[1])
    )
    checked = checks.all_carbon_check(flows, fluxes.harvest_stocks(cut, until=t.years[1]), tolerance=0.01)
    return checked.groupBy("pool", "status").agg(F.count("*").alias("n_rows"))


def _fix(expr: str) -> str:
    """Whole ten-thousandths, 0 for null."""
    return f"coalesce(CAST(floor(({expr}) * 1e4 + 0.5) AS BIGINT), 0)"


_ROLLED = f"""
    WITH RECURSIVE cells AS (
      SELECT b.unit_id, b.year, b.land_use, area, {fx('biomass')} AS biomass, {fx('growth')} AS growth,
             {fx('carbon_fraction')} AS cf, {fx('root_ratio')} AS root_ratio FROM uy b
    ), asked AS (
      SELECT c.unit_id, c.year, c.land_use, c.root_ratio, {_fix('c.area * c.biomass')} AS full_stock,
             {_fix('c.area * c.growth * c.cf')} AS growth, {_fix('h.carbon')} AS cut,
             {_fix('c.area * c.biomass * s.severity')} AS fire,
             row_number() OVER (PARTITION BY c.unit_id ORDER BY c.year) AS place
      FROM cells c LEFT JOIN (SELECT unit_id, year, carbon FROM harvest_f) h USING (unit_id, year)
      LEFT JOIN (SELECT unit_id, year, severity FROM burn) s USING (unit_id, year)
    ), moved AS (
      SELECT a.*, a.growth + CASE WHEN b.land_use <> a.land_use THEN a.full_stock - b.full_stock ELSE 0 END AS come
      FROM asked a LEFT JOIN asked b ON b.unit_id = a.unit_id AND b.place = a.place - 1
    ), rolled AS (
      SELECT *, full_stock AS start_stock, least(greatest(full_stock + come, 0), full_stock) AS standing FROM moved WHERE place = 1
      UNION ALL
      SELECT m.*, r.stock, least(greatest(r.stock + m.come, 0), m.full_stock) FROM moved m JOIN (
        SELECT unit_id, place,
               standing - least(cut, standing) - least(fire, standing - least(cut, standing)) AS stock FROM rolled) r
        ON m.unit_id = r.unit_id AND m.place = r.place + 1
    )
    SELECT unit_id, year, root_ratio, (standing - start_stock) / 1e4 AS gained, least(cut, standing) / 1e4 AS harvested,
           least(fire, standing - least(cut, standing)) / 1e4 AS burned,
           (standing - least(cut, standing) - least(fire, standing - least(cut, standing))) / 1e4 AS stock,
           cut / 1e4 AS asked_harvest, fire / 1e4 AS asked_fire FROM rolled"""


@query("unit_id:i year:i gained:d harvested:d burned:d stock:d asked_harvest:d asked_fire:d", _ROLLED)
def biomass_stocks(t):
    """Stocks that no series of fires and harvests takes below zero."""
    return stocks.biomass_stocks(inputs.state(t), t.disturbance, t.land_unit, t.factor, t.years)


@query(
    ROWS,
    " UNION ALL ".join(
        entry(pool, process, "CO2", expr, f"(SELECT * FROM ({_ROLLED}) WHERE {column} > 0)")
        for process, column in (("harvest", "harvested"), ("fire", "burned"))
        for pool, expr in (("AGB", f"-{column}"), ("BGB", f"-{column} * root_ratio"))
    ),
)
def capped_losses(t):
    return stocks.capped_losses(stocks.biomass_stocks(inputs.state(t), t.disturbance, t.land_unit, t.factor, t.years))


_AHEAD = 100
_POOLS = " UNION ALL ".join(
    f"""SELECT country_id, '{pool}' AS pool, y.year, sum(CASE WHEN y.year = h.year THEN carbon * {share} ELSE 0 END) AS inflow,
               sum(carbon * {share} * {left}) AS stock,
               sum(carbon * {share} * (CASE WHEN y.year = h.year THEN 1 ELSE {left_before} END - {left})) AS lost
        FROM harvest_f h, (SELECT unnest(range(y0, y1 + {_AHEAD} + 1)) AS year FROM span) y
        WHERE y.year >= h.year GROUP BY country_id, y.year"""
    for pool, share, left, left_before in (
        ("DW", "debris_share", f"exp(-({_SINCE} + 1) / debris_years)", f"exp(-{_SINCE} / debris_years)"),
        (
            "HWP",
            "product_share",
            f"(exp(-product_decay * {_SINCE}) * {_LEFT})",
            f"(exp(-product_decay * ({_SINCE} - 1)) * {_LEFT})",
        ),
    )
)


@query("country_id:i pool:s year:i inflow:r4 stock:r4 lost:r4", _POOLS)
def decaying_pools(t):
    """Products and debris of all harvests, a hundred years ahead."""
    first, last = t.years
    return stocks.decaying_pools(inputs.harvest(t), ["country_id"], (first, last + _AHEAD))
