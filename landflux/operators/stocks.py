"""Stocks rolled on from year to year.

``fluxes`` books a loss against factors and does not know what earlier losses have
left. Here every unit has a stock: it grows up to the full stock of its class, and
no harvest or fire takes more than stands. Products and dead wood decay as a
recurrence, with one row a series and year however many years flow in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landflux.functions.amounts import fixed_sql
from landflux.operators import fluxes
from landflux.operators.factors import resolve_factors
from landflux.operators.scans import compose_clamped, compose_linear, running
from landflux.sources.schemas import MONEY

UNFIXED = f"cast({{0}} * 0.0001BD as {MONEY})"


def biomass_stocks(
    state: DataFrame, disturbance: DataFrame, units: DataFrame, factor: DataFrame, years: tuple[int, int]
) -> DataFrame:
    """Biomass above ground of each unit at the end of each year of ``years``, and what moved it.

    A unit starts at the full stock of its first known class. In a year it first
    gains its growth and, if the class has changed, the difference of the full
    stocks, staying between nothing and the full stock; then the harvest takes
    what it asks for, then the fire, neither more than stands. A class without a
    biomass factor has no stock. Columns: gained (growth and conversion),
    harvested, burned, stock; asked_harvest and asked_fire are what the events
    asked for. Amounts are summed as whole ten-thousandths, so the order of
    composition does not matter.
    """
    events = fluxes.harvest_carbon(disturbance, units, factor).select("unit_id", "year", F.col("carbon").alias("_cut"))
    params = ["biomass", "root_ratio", "growth", "carbon_fraction"]
    known = fluxes.unit_years(state, units).filter(F.col("year").between(*years))
    cells = resolve_factors(known, factor, params)
    cells = cells.join(events, ["unit_id", "year"], "left").join(fluxes.fire_severity(disturbance), ["unit_id", "year"], "left")

    def fixed(expression: str):
        return F.coalesce(F.expr(fixed_sql(expression)), F.lit(0)).cast("bigint")

    line = Window.partitionBy("unit_id").orderBy("year")
    steps = cells.select(
        "unit_id",
        "year",
        "land_use",
        "root_ratio",
        fixed("area * biomass").alias("_full"),
        fixed("area * growth * carbon_fraction").alias("_growth"),
        fixed("_cut").alias("_cut"),
        fixed("area * biomass * severity").alias("_fire"),
    ).withColumns({"_full_before": F.lag("_full").over(line), "_use_before": F.lag("land_use").over(line)})
    moved = F.when(F.col("_use_before") != F.col("land_use"), F.col("_full") - F.col("_full_before")).otherwise(0)
    steps = steps.withColumn("_come", F.col("_growth") + moved)
    none = F.lit(0).cast("bigint")
    after_cut = F.greatest(F.col("_full") - F.col("_cut"), none)
    most = F.greatest(after_cut - F.col("_fire"), none)
    begins = F.col("_full_before").isNull()
    # the first year starts at the full stock, whatever came before: a step that leads to one value
    steps = steps.withColumns(
        {
            "add": F.col("_come") - F.col("_cut") - F.col("_fire"),
            "low": F.when(begins, most).otherwise(none),
            "high": most,
        }
    )
    rolled = running(steps, ["unit_id"], "year", ["add", "low", "high"], compose_clamped, years[1] - years[0] + 1)
    # all steps up to the first lead to one value, so low and high are the stock
    rolled = rolled.withColumn("_stock", F.col("high"))
    before = F.coalesce(F.lag("_stock").over(line), F.col("_full"))
    rolled = rolled.withColumn("_start", before)
    rolled = rolled.withColumn("_standing", F.least(F.greatest(F.col("_start") + F.col("_come"), none), F.col("_full")))
    rolled = rolled.withColumn("_taken", F.least("_cut", "_standing"))
    rolled = rolled.withColumn("_burned", F.least(F.col("_fire"), F.col("_standing") - F.col("_taken")))
    shown = {
        "gained": "(_standing - _start)",
        "harvested": "_taken",
        "burned": "_burned",
        "stock": "_stock",
        "asked_harvest": "_cut",
        "asked_fire": "_fire",
    }
    return rolled.selectExpr(
        "unit_id", "year", "land_use", "root_ratio", *[f"{UNFIXED.format(of)} as {name}" for name, of in shown.items()]
    )


def capped_losses(stocks: DataFrame) -> DataFrame:
    """Ledger rows of ``biomass_stocks``: what harvests and fires took, roots in proportion.

    In place of ``harvest_loss`` and ``disturbance_loss`` where a unit may be hit
    in several years. A year in which nothing was left to take has no row.
    """
    parts = []
    for process, column in (("harvest", "harvested"), ("fire", "burned")):
        lost = f"cast({column} as double)"
        rows = stocks.filter(f"{column} > 0")
        parts.append(fluxes.entries(rows, process, [("AGB", f"-{lost}"), ("BGB", f"-{lost} * root_ratio")]))
    return fluxes.ledger(*parts)


def decaying_pools(harvest: DataFrame, by: list[str], years: tuple[int, int]) -> DataFrame:
    """Products (HWP) and debris (DW) per ``by`` and year up to ``years[1]``: inflow, stock and loss.

    ``harvest`` is ``harvest_carbon``, with no year before ``years[0]``. A series
    holds the inflows of one ``by`` and one speed of decay; its stock is what the
    year before has left, less the year's decay, and the year's inflow. So there
    are as many rows as series and years. Without decay products stand for ever;
    debris that lasts no time is lost in its year. Inflows whose share or speed has
    no factor are in no pool.
    """
    k, life = "product_decay", "debris_years"
    products = f"named_struct('pool', 'HWP', 'inflow', carbon * product_share, 'keep', exp(-{k}), 'stays', {fluxes.STANDING})"
    debris = (
        f"named_struct('pool', 'DW', 'inflow', carbon * debris_share, 'keep', {fluxes.LEFT_A_YEAR}, 'stays', {fluxes.LEFT_A_YEAR})"
    )
    flows = harvest.filter(F.col("year") <= years[1]).selectExpr(*by, "year", f"inline(array({products}, {debris}))")
    flows = flows.filter("inflow is not null and keep is not null")
    series = [*by, "pool", "keep", "stays"]
    summed = flows.groupBy(*series, "year").agg(F.sum("inflow").alias("inflow"))
    line = Window.partitionBy(*series).orderBy("year")
    last = F.coalesce(F.lead("year").over(line) - 1, F.lit(years[1]))
    listed = summed.withColumn("_last", last).withColumn("_year", F.explode(F.sequence("year", "_last")))
    fresh = F.when(F.col("_year") == F.col("year"), F.col("inflow")).otherwise(0.0)
    steps = listed.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(series)], "keep", "stays", F.col("_year").alias("year"), fresh.alias("inflow"))
    steps = steps.withColumn("come", F.col("stays") * F.col("inflow")).drop("stays")
    keys = [f"_k{i}" for i in range(len(series))]
    rolled = running(steps, keys, "year", ["keep", "come"], compose_linear, years[1] - years[0] + 1)
    # nothing stands before a series' first year, so what has come is the stock
    line = Window.partitionBy(*keys).orderBy("year")
    rolled = rolled.withColumn("_before", F.coalesce(F.lag("come").over(line), F.lit(0.0)))
    named = rolled.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate([*by, "pool"])],
        "year",
        "inflow",
        F.col("come").alias("stock"),
        (F.col("_before") + F.col("inflow") - F.col("come")).alias("lost"),
    )
    return named.groupBy(*by, "pool", "year").agg(*[F.sum(c).alias(c) for c in ("inflow", "stock", "lost")])
