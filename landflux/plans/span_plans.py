"""Queries on spans of years from stored sketches, and reports on the stored full ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from landflux.functions import user_curve_rows
from landflux.operators import fluxes, report, sketches
from landflux.plans import flux_plans, inputs
from landflux.plans.check_sql import Y1, amt
from landflux.plans.registry import REGISTRY, query
from landflux.session import keep, run_dir
from landflux.sources import read_ledger, write_ledger

_SPANS = """(SELECT a.year AS first_year, b.year AS last_year FROM
    (SELECT unnest(range(y0, y1 + 1)) AS year FROM span) a JOIN
    (SELECT unnest(range(y0, y1 + 1)) AS year FROM span) b ON a.year <= b.year)"""


def _spans(t):
    """Every span of the observed years."""
    first, last = t.years
    years = t.spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("first_year"))
    return years.withColumn("last_year", F.explode(F.sequence("first_year", F.lit(last))))


def _stored(t, rows, name):
    """Written in two steps, the last year again, as a yearly update does, and read back."""
    path = run_dir(t.spark, name)
    sketches.write_sketches(rows, path)
    sketches.write_sketches(rows.filter(F.col("year") == t.years[1]), path)
    return sketches.read_sketches(t.spark, path)


@query(
    "first_year:i last_year:i n_units:i n_providers:i units_within:b providers_within:b",
    f"""SELECT first_year, last_year, count(DISTINCT unit_id) AS n_units, count(DISTINCT provider_id) AS n_providers,
               true AS units_within, true AS providers_within
        FROM {_SPANS} JOIN land_obs ON year BETWEEN first_year AND last_year GROUP BY ALL""",
)
def coverage_of_spans(t):
    """Counts of every span from the sketches, beside the exact ones: within four standard errors."""
    spans = _spans(t)
    found = sketches.coverage_of_spans(_stored(t, sketches.coverage_sketches(t.land_obs), "seen"), spans)
    exact = report.counts_of_spans(t.land_obs, spans)

    def within(approx: str, n: str):
        return F.abs(F.col(approx) - F.col(n)) <= 4 * sketches.COUNT_ERROR * F.col(n)

    return exact.join(found, ["first_year", "last_year"], "left").select(
        "*",
        F.coalesce(within("approx_units", "n_units"), F.lit(False)).alias("units_within"),
        F.coalesce(within("approx_providers", "n_providers"), F.lit(False)).alias("providers_within"),
    )


_PROBS = {"p05": 0.05, "median": 0.5, "p95": 0.95}


@query(
    "region_id:i first_year:i last_year:i n:i within_bounds:b",
    f"""SELECT region_id, first_year, last_year, count(*) AS n, true AS within_bounds
        FROM {_SPANS} JOIN (SELECT DISTINCT region_id, year, unit_id FROM core_placed)
             ON year BETWEEN first_year AND last_year GROUP BY ALL""",
)
def distribution_of_spans(t):
    """Percentiles of every region and span from the sketches, and whether their exact ranks are near enough."""
    ledger, spans = keep(inputs.placed_core(t), "placed"), _spans(t)
    stored = _stored(t, sketches.flux_sketches(ledger, ["region_id"]), "amounts")
    found = sketches.distribution_of_spans(stored, spans, ["region_id"], _PROBS)
    years = found.withColumn("year", F.explode(F.sequence("first_year", "last_year")))
    yearly = report.totals(ledger, ["region_id", "year", "unit_id"]).withColumn("amount", F.col("amount").cast("double"))
    ranks = yearly.join(years, ["region_id", "year"]).groupBy("region_id", "first_year", "last_year", "n").agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col("amount") < F.col(p)).alias(f"_{p}_below") for p in _PROBS],
        *[F.count_if(F.col("amount") <= F.col(p)).alias(f"_{p}_upto") for p in _PROBS],
    )
    near = F.col("n") == F.col("_n")
    for name, p in _PROBS.items():
        off = 2 * sketches.RANK_ERROR * F.col("n") + 1
        near &= (F.col(f"_{name}_below") - off <= p * F.col("n")) & (F.col(f"_{name}_upto") + off >= p * F.col("n"))
    return ranks.withColumn("within_bounds", near)


@query(
    "region_id:i process:s year:i level:i amount:d",
    f"""SELECT region_id, process, year, sum(amount) AS amount, GROUPING(region_id, process, year) AS level
        FROM (SELECT region_id, process, year, {amt(
            "CAST(amount AS DOUBLE) * CASE WHEN gas = 'CO2' THEN 44e0 / 12e0 ELSE 1e0 END * value"
        )} AS amount
              FROM ({REGISTRY[flux_plans.full_ledger.__name__].body})
              JOIN (SELECT * FROM gwp WHERE gwp_set = 'AR6') USING (gas) JOIN place USING (unit_id))
        GROUP BY ROLLUP (region_id, process, year)""",
)
def full_report(t):
    """All pools and gases in tonnes of CO2-equivalent: the ledger is stored by year, the report scans it."""
    path = run_dir(t.spark, "full-ledger")
    write_ledger(inputs.full_ledger(t), path)
    stored = fluxes.in_co2e(read_ledger(t.spark, path), t.gwp, "AR6")
    return report.report_rollup(report.with_region(stored, t.land_unit, t.country), ["region_id", "process", "year"])


@query(
    "unit_id:i year:i pool:s process:s gas:s amount:d unit:s",
    f"""WITH v AS (SELECT from_use, to_use, pool, age, share * (4 - age) / 10e0 AS share
                   FROM (SELECT from_use, to_use, pool, share FROM curves WHERE age = 0),
                        (SELECT unnest(range(4)) AS age))
        SELECT unit_id, c.year + v.age AS year, v.pool, 'legacy' AS process, 'CO2' AS gas, 'tC' AS unit,
               sum({amt('area * v.share')}) AS amount
        FROM chg c JOIN v ON c.use_from = v.from_use AND c.use_to = v.to_use
        WHERE c.year + v.age <= {Y1} AND c.year + v.age < coalesce(next_change, 9999) GROUP BY ALL""",
)
def user_curve_bookkeeping(t):
    """Legacy fluxes by a user's curves: steps that fall evenly over four years."""

    def falling(total, years):
        for age in range(years):
            yield age, total * (years - age) / (years * (years + 1) / 2)

    params = t.curves.filter("age = 0").select(
        "from_use", "to_use", "pool", F.col("share").alias("total"), F.lit(4).alias("years")
    )
    curves = user_curve_rows(params, falling, ["total", "years"])
    return fluxes.bookkeeping(inputs.state(t), t.land_unit, curves, until=t.years[1])
