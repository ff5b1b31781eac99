"""Queries on reports, uncertainty and the carbon checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from landflux.functions import amount
from landflux.operators import checks, factors, fluxes, report, uncertainty
from landflux.plans import inputs
from landflux.plans.check_sql import amt, both, entry, fx
from landflux.plans.registry import query

DIMS = ["region_id", "country_id", "year"]
_SUBTOTAL = """SELECT region_id, country_id, year, sum(amount) AS amount,
    GROUPING(region_id, country_id, year) AS level FROM fl GROUP BY {}"""
_SUB_COLUMNS = "region_id:i country_id:i year:i level:i amount:d"


@query(_SUB_COLUMNS, _SUBTOTAL.format("ROLLUP (region_id, country_id, year)"))
def report_rollup(t):
    return report.report_rollup(inputs.placed_ledger(t), DIMS)


@query(
    "region_id:i process:s pool:s level:i amount:d",
    """SELECT region_id, process, pool, sum(amount) AS amount, GROUPING(region_id, process, pool) AS level
       FROM fl GROUP BY CUBE (region_id, process, pool)""",
)
def report_cube(t):
    return report.report_cube(inputs.placed_ledger(t), ["region_id", "process", "pool"])


@query(_SUB_COLUMNS, _SUBTOTAL.format("GROUPING SETS ((region_id, year), (country_id), ())"))
def report_sets(t):
    return report.report_sets(inputs.placed_ledger(t), [["region_id", "year"], ["country_id"], []], DIMS)


_YEARLY = "(SELECT region_id, year, sum(amount) AS amount FROM fl GROUP BY ALL)"


@query(
    "region_id:i year:i amount:d cumulative:d",
    f"""SELECT *, sum(amount) OVER (PARTITION BY region_id ORDER BY year) AS cumulative
        FROM {_YEARLY} WHERE year >= 1997""",
)
def cumulative_flux(t):
    return report.cumulative_flux(inputs.placed_ledger(t), ["region_id"], 1997)


@query(
    "region_id:i year:i amount:d moving_mean:r4",
    f"""SELECT *, CAST(sum(amount) OVER w AS DOUBLE) / count(*) OVER w AS moving_mean FROM {_YEARLY}
        WINDOW w AS (PARTITION BY region_id ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def moving_mean(t):
    return report.moving_mean(inputs.placed_ledger(t), ["region_id"], 3)


@query(
    "region_id:i year:i amount:d baseline:r4 difference:r4",
    f"""WITH y AS {_YEARLY}, base AS (
          SELECT region_id, CAST(sum(amount) AS DOUBLE) / count(*) AS baseline FROM y
          WHERE year BETWEEN 1996 AND 1998 GROUP BY region_id)
        SELECT y.*, baseline, CAST(amount AS DOUBLE) - baseline AS difference
        FROM y LEFT JOIN base USING (region_id)""",
)
def versus_baseline(t):
    return report.versus_baseline(inputs.placed_ledger(t), ["region_id"], 1996, 1998)


@query(
    "region_id:i year:i amount:d change:r4 relative:r6",
    f"""WITH y AS {_YEARLY}
        SELECT a.*, CAST(a.amount - b.amount AS DOUBLE) AS change,
               CAST(a.amount - b.amount AS DOUBLE) / nullif(CAST(abs(b.amount) AS DOUBLE), 0) AS relative
        FROM y a LEFT JOIN y b ON a.region_id = b.region_id AND a.year = b.year + 1""",
)
def year_on_year(t):
    return report.year_on_year(inputs.placed_ledger(t), ["region_id"])


@query(
    "region_id:i unit_id:i amount:d place:i",
    """SELECT region_id, unit_id, sum(amount) AS amount,
              row_number() OVER (PARTITION BY region_id ORDER BY sum(amount), unit_id) AS place
       FROM fl GROUP BY region_id, unit_id QUALIFY place <= 10""",
)
def top_emitters(t):
    return report.top_emitters(inputs.placed_ledger(t), 10, "region_id", "unit_id")


@query(
    "process:s pool:s zone:s amount:d cumulative_share:r6 own_share:r6",
    """WITH c AS (SELECT process, pool, zone, sum(amount) AS amount, abs(sum(amount)) AS size
                  FROM fl GROUP BY process, pool, zone),
       r AS (SELECT *, CAST(sum(size) OVER () AS DOUBLE) AS total, CAST(sum(size) OVER (
               ORDER BY size DESC, process, pool, zone ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto FROM c)
       SELECT process, pool, zone, amount, upto / total AS cumulative_share,
              CAST(size AS DOUBLE) / total AS own_share
       FROM r WHERE (upto - CAST(size AS DOUBLE)) / total < 0.95""",
)
def key_categories(t):
    return report.key_categories(inputs.placed_ledger(t), ["process", "pool", "zone"])


@query(
    "country_id:i slope:r4 intercept:r2 r2:r6",
    """SELECT country_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2
       FROM (SELECT country_id, CAST(year AS DOUBLE) AS x, CAST(sum(amount) AS DOUBLE) AS y
             FROM fl GROUP BY country_id, year) GROUP BY country_id""",
)
def trend(t):
    return report.trend(inputs.placed_ledger(t), ["country_id"])


_UNIT = "(SELECT region_id, unit_id, sum(amount) AS amount FROM fl GROUP BY ALL)"
_CUTS = ", ".join(
    f"quantile_cont(CAST(amount AS DOUBLE), {p}) AS {name}"
    for name, p in [("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)]
)


@query(
    "region_id:i n:i p05:r4 p25:r4 median:r4 p75:r4 p95:r4",
    f"SELECT region_id, count(*) AS n, {_CUTS} FROM {_UNIT} GROUP BY region_id",
)
def distribution(t):
    return report.distribution(inputs.placed_ledger(t), ["region_id"])


@query(
    "region_id:i unit_id:i amount:d quartile:i",
    f"""SELECT u.region_id, unit_id, amount, CASE WHEN CAST(amount AS DOUBLE) <= p25 THEN 1
               WHEN CAST(amount AS DOUBLE) <= median THEN 2 WHEN CAST(amount AS DOUBLE) <= p75 THEN 3
               ELSE 4 END AS quartile
        FROM {_UNIT} u JOIN (SELECT region_id, {_CUTS} FROM {_UNIT} GROUP BY region_id) c
             ON u.region_id IS NOT DISTINCT FROM c.region_id""",
)
def unit_quartiles(t):
    return report.unit_quartiles(inputs.placed_ledger(t), ["region_id"])


@query(
    "year:i n_units:i n_providers:i",
    """SELECT year, count(DISTINCT unit_id) AS n_units, count(DISTINCT provider_id) AS n_providers
       FROM land_obs GROUP BY year""",
)
def coverage(t):
    return report.coverage(t.land_obs)


@query(
    "year:i n_units:i within_bounds:b",
    "SELECT year, count(DISTINCT unit_id) AS n_units, true AS within_bounds FROM land_obs GROUP BY year",
)
def approximate_coverage(t):
    """Whether the approximate count lies within three standard errors of the exact one."""
    seen = report.coverage(t.land_obs)
    off = F.abs(F.col("approx_units") - F.col("n_units"))
    return seen.withColumn("within_bounds", off <= 3 * report.APPROX_ERROR * F.col("n_units"))


@query(
    "region_id:i country_id:i amount:d share_within:r6 share_world:r6",
    """WITH c AS (SELECT region_id, country_id, sum(amount) AS amount FROM fl GROUP BY ALL)
       SELECT *, CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY region_id) AS DOUBLE)
                   AS share_within,
              CAST(amount AS DOUBLE) / CAST(sum(amount) OVER () AS DOUBLE) AS share_world FROM c""",
)
def share_of_total(t):
    return report.share_of_total(inputs.placed_ledger(t), "country_id", "region_id")


@query(
    "country_id:i zone:s land_use:s year:i rel_unc:r6",
    f"""SELECT country_id, zone, land_use, year, sqrt(
               pow({fx('growth', take='rel_unc')}, 2) + pow({fx('carbon_fraction', take='rel_unc')}, 2)) AS rel_unc
        FROM (SELECT DISTINCT country_id, zone, land_use, year FROM uy) b""",
)
def propagate_product(t):
    keys = ["country_id", "zone", "land_use", "year"]
    df = fluxes.unit_years(inputs.state(t), t.land_unit).select(*keys).distinct()
    df = factors.resolve_factors(df, t.factor, ["growth", "carbon_fraction"], with_tier=True)
    return uncertainty.propagate_product(df, ["growth_unc", "carbon_fraction_unc"])


_PARTS = f"""SELECT region_id, {amt('area * growth * cf')} AS amount, rel_unc,
    concat_ws('|', tier, CASE WHEN tier IN (1, 2, 3, 5) THEN country_id END,
              CASE WHEN tier IN (1, 2, 4, 6) THEN zone END,
              CASE WHEN tier IN (1, 3, 4, 7) THEN land_use END) AS factor_key
  FROM (SELECT b.*, {fx('growth', take='rel_unc')} AS rel_unc, {fx('growth', take='tier')} AS tier
        FROM (SELECT gain_f.*, region_id FROM gain_f JOIN country_dim USING (country_id)) b)"""


def growth_parts(t):
    """Growth above ground with the factor behind it."""
    df = fluxes.unit_years(inputs.state(t), t.land_unit).join(
        t.country.select("country_id", "region_id"), "country_id"
    )
    df = factors.resolve_factor(df, t.factor, "growth")
    df = factors.resolve_factors(df, t.factor, ["carbon_fraction"])
    tier = F.col("growth_tier")
    key = F.concat_ws(
        "|",
        tier.cast("string"),
        *[F.when(tier.isin(factors.tiers_with(k)), F.col(k).cast("string")) for k in factors.SCOPE],
    )
    grown = F.col("area") * F.col("growth") * F.col("carbon_fraction")
    return df.select(
        "region_id",
        key.alias("factor_key"),
        amount(grown).alias("amount"),
        F.col("growth_unc").alias("rel_unc"),
    )


@query(
    "region_id:i amount:d rel_unc:r6",
    f"""SELECT region_id, sum(amount) AS amount,
               sqrt(sum(pow(CAST(amount AS DOUBLE) * rel_unc, 2))) / abs(CAST(sum(amount) AS DOUBLE)) AS rel_unc
        FROM (SELECT region_id, factor_key, sum(amount) AS amount, max(rel_unc) AS rel_unc
              FROM ({_PARTS}) GROUP BY ALL) GROUP BY region_id""",
)
def propagate_sum(t):
    by_factor = growth_parts(t).groupBy("region_id", "factor_key").agg(
        F.sum("amount").alias("amount"), F.max("rel_unc").alias("rel_unc")
    )
    return uncertainty.propagate_sum(by_factor, ["region_id"])


def _uniform(tail: str) -> str:
    text = f"md5(concat_ws('|', '42', factor_key, draw, '{tail}'))"
    return f"((CAST('0x' || substr({text}, 1, 8) AS BIGINT) + 0.5) / 4294967296e0)"


@query(
    "region_id:i mean:r2 sd:r2 p025:r2 p500:r2 p975:r2",
    f"""WITH drawn AS (
          SELECT region_id, draw, sum(CAST(amount AS DOUBLE) * (1 + rel_unc
                 * sqrt(-2 * ln({_uniform('r')})) * cos(2 * pi() * {_uniform('a')}))) AS total
          FROM (SELECT region_id, factor_key, sum(amount) AS amount, max(rel_unc) AS rel_unc
                FROM ({_PARTS}) GROUP BY ALL), (SELECT unnest(range(2000)) AS draw)
          GROUP BY region_id, draw)
        SELECT region_id, avg(total) AS mean, stddev_samp(total) AS sd, quantile_cont(total, 0.025) AS p025,
               quantile_cont(total, 0.5) AS p500, quantile_cont(total, 0.975) AS p975
        FROM drawn GROUP BY region_id""",
)
def monte_carlo(t):
    return uncertainty.monte_carlo(growth_parts(t), ["region_id"], draws=2000, seed=42)


_MOVED = f"""SELECT unit_id, year, pool, stock - lag(stock) OVER (
    PARTITION BY unit_id, pool ORDER BY year) AS stock_change
  FROM (SELECT unit_id, year, 'AGB' AS pool, {amt("area * " + fx('biomass'))} AS stock FROM uy b
        UNION ALL SELECT unit_id, year, 'BGB' AS pool,
               {amt("area * (" + fx('biomass') + " * " + fx('root_ratio') + ")")} AS stock FROM uy b)"""


@query(
    "year:i pool:s status:s n_rows:i difference:d",
    f"""WITH moved AS (SELECT * FROM ({_MOVED}) WHERE stock_change IS NOT NULL),
        flows AS (SELECT unit_id, year, pool, sum(amount) AS flux FROM (
                    {both('SELECT * FROM conv', 'SELECT * FROM fire')}) GROUP BY ALL),
        gaps AS (SELECT year, pool, stock_change, flux,
                        coalesce(stock_change, 0) - coalesce(flux, 0) AS difference
                 FROM moved FULL JOIN flows USING (unit_id, year, pool))
        SELECT year, pool, CASE WHEN stock_change IS NULL THEN 'no stock' WHEN abs(difference) <= 0.001
               THEN 'balanced' WHEN flux IS NULL THEN 'no flux' ELSE 'off' END AS status,
               count(*) AS n_rows, sum(difference) AS difference
        FROM gaps GROUP BY ALL""",
)
def all_carbon_check(t):
    """Stocks follow conversions; the fires the stocks leave out show up as gaps."""
    st = inputs.state(t)
    held = factors.resolve_factors(fluxes.unit_years(st, t.land_unit), t.factor, ["biomass", "root_ratio"])
    above, below = F.col("area") * F.col("biomass"), F.col("area") * (F.col("biomass") * F.col("root_ratio"))
    both_pools = F.array(
        F.struct(F.lit("AGB").alias("pool"), amount(above).alias("stock")),
        F.struct(F.lit("BGB").alias("pool"), amount(below).alias("stock")),
    )
    stocks = held.select("unit_id", "year", F.inline(both_pools))
    flows = fluxes.ledger(
        fluxes.conversion_biomass(st, t.land_unit, t.factor),
        fluxes.disturbance_loss(t.disturbance, st, t.land_unit, t.factor),
    )
    return (
        checks.all_carbon_check(flows, stocks)
        .groupBy("year", "pool", "status")
        .agg(F.count("*").alias("n_rows"), F.sum("difference").alias("difference"))
    )


@query(
    "unit_id:i pool:s",
    """SELECT u.unit_id, p.pool FROM land_unit u, (SELECT unnest(['AGB', 'BGB', 'DW', 'HWP']) AS pool) p
       WHERE NOT EXISTS (SELECT 1 FROM (SELECT unit_id, pool FROM core UNION ALL SELECT unit_id, pool FROM fire) e
                         WHERE e.unit_id = u.unit_id AND e.pool = p.pool)""",
)
def missing_pools(t):
    """What the three-part ledger and fires leave out: no dead wood, no products."""
    st = inputs.state(t)
    entries = fluxes.ledger(
        inputs.core_ledger(t), fluxes.disturbance_loss(t.disturbance, st, t.land_unit, t.factor)
    )
    return checks.missing_pools(entries, entries.filter(F.lit(False)), t.land_unit, ["AGB", "BGB", "DW", "HWP"])


@query(
    "claim_id:s unit_id:i kind:s start_date:t end_date:t n_overlaps:i",
    """SELECT a.claim_id, a.unit_id, a.kind, a.start_date, a.end_date, count(*) AS n_overlaps
       FROM claim a JOIN claim b ON a.unit_id = b.unit_id AND a.claim_id <> b.claim_id
            AND a.start_date <= b.end_date AND b.start_date <= a.end_date GROUP BY ALL""",
)
def double_count(t):
    return checks.double_count(t.claim)


@query(
    "unit_id:i year:i n_rows:i reason:s",
    f"""SELECT unit_id, year, n_rows, CASE WHEN area IS NULL THEN 'no unit' WHEN land_use IS NULL THEN 'no class'
               WHEN {fx('rewetting_CH4')} IS NULL THEN 'no factor' END AS reason
        FROM (SELECT e.unit_id, e.year, n_rows, country_id, zone, area, land_use
              FROM (SELECT unit_id, year, count(*) AS n_rows FROM disturbance WHERE kind = 'fire' GROUP BY ALL) e
              LEFT JOIN land_unit ON e.unit_id = land_unit.unit_id
              LEFT JOIN state ON e.unit_id = state.unit_id AND e.year = state.year) b
        WHERE reason IS NOT NULL""",
)
def unbooked_rows(t):
    """Fires on land for which one factor is missing."""
    fires = t.disturbance.filter("kind = 'fire'").select("unit_id", F.year("event_date").alias("year"))
    return checks.unbooked_rows(fires, inputs.state(t), t.land_unit, t.factor, ["rewetting_CH4"])


# the second run lacks the general growth factor and the zone values of BUILDING
_RUN_B = (
    f"SELECT b.*, growth_b AS growth, {fx('root_ratio')} AS root_ratio, {fx('carbon_fraction')} AS cf FROM "
    "(SELECT uy.*, (SELECT arg_min(f.value, f.tier * 100000 - coalesce(f.valid_from, -9999)) FROM factor f "
    "WHERE f.param = 'growth' AND uy.year >= coalesce(f.valid_from, -9999) "
    "AND uy.year <= coalesce(f.valid_to, 99999) AND f.tier < 8 "
    "AND coalesce(f.zone, '') <> 'BUILDING' AND (f.country_id IS NULL OR f.country_id = uy.country_id) "
    "AND (f.zone IS NULL OR f.zone = uy.zone) "
    "AND (f.land_use IS NULL OR f.land_use = uy.land_use)) AS growth_b FROM uy) b"
)
_GAIN_B = both(
    entry("AGB", "growth", "CO2", "area * growth * cf", f"({_RUN_B})"),
    entry("BGB", "growth", "CO2", "area * growth * cf * root_ratio", f"({_RUN_B})"),
)
_KEYS = "unit_id, year, pool, process, gas"


def _two_runs(t):
    st = inputs.state(t)
    general = F.coalesce("land_use", "zone", F.col("country_id").cast("string"), F.lit("none")) == "none"
    dropped = (F.col("param") == "growth") & (general | F.col("zone").eqNullSafe("BUILDING"))
    return (
        fluxes.biomass_gain(st, t.land_unit, t.factor),
        fluxes.biomass_gain(st, t.land_unit, t.factor.filter(~dropped)),
    )


@query(
    "unit_id:i year:i pool:s process:s gas:s amount_a:d amount_b:d change:s",
    f"""SELECT {_KEYS}, a.amount AS amount_a, b.amount AS amount_b,
               CASE WHEN b.amount IS NULL THEN 'removed' WHEN a.amount IS NULL THEN 'added' ELSE 'changed' END
                 AS change
        FROM gain a FULL JOIN ({_GAIN_B}) b USING ({_KEYS}) WHERE a.amount IS DISTINCT FROM b.amount""",
)
def compare_runs(t):
    return checks.compare_runs(*_two_runs(t))


@query(
    "unit_id:i year:i pool:s amount:d",
    f"""SELECT unit_id, year, pool, amount FROM gain
        EXCEPT ALL SELECT unit_id, year, pool, amount FROM ({_GAIN_B})""",
)
def rows_only_in_first_run(t):
    a, b = (run.select("unit_id", "year", "pool", "amount") for run in _two_runs(t))
    return checks.rows_only_in(a, b)


@query(
    "unit_id:i year:i pool:s amount:d",
    f"""SELECT unit_id, year, pool, amount FROM gain
        INTERSECT ALL SELECT unit_id, year, pool, amount FROM ({_GAIN_B})""",
)
def rows_in_both_runs(t):
    a, b = (run.select("unit_id", "year", "pool", "amount") for run in _two_runs(t))
    return checks.rows_in_both(a, b)
