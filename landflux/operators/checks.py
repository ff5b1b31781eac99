"""Checks that land and carbon are counted once and wholly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landflux.operators.factors import resolve_factors
from landflux.sources.schemas import MONEY


def all_land_check(state: DataFrame, units: DataFrame) -> DataFrame:
    """Per year: area with a class, area not yet observed, and what is missing, doubled or foreign.

    ``balanced`` holds where no unit has two rows, none is unknown to ``units``,
    and both areas add up to the area of all units.
    """
    per_unit = state.groupBy("unit_id", "year").agg(
        F.count("*").alias("n"), F.count("land_use").alias("n_classes")
    )
    world = units.agg(F.sum("area_ha").alias("total")).select("total")
    known = F.col("n_classes") > 0
    zero = F.lit(0).cast(MONEY)
    return (
        per_unit.join(units.select("unit_id", "area_ha", F.lit(True).alias("_own")), "unit_id", "left")
        .groupBy("year")
        .agg(
            F.sum(F.when(known, F.col("area_ha")).otherwise(zero)).alias("classified_ha"),
            F.sum(F.when(~known, F.col("area_ha")).otherwise(zero)).alias("unobserved_ha"),
            F.count(F.when(F.col("n") > 1, 1)).alias("n_doubled"),
            F.count(F.when(~known, 1)).alias("n_unobserved"),
            F.count(F.when(F.col("_own").isNull(), 1)).alias("n_foreign"),
        )
        .withColumn("missing_ha", world.scalar() - F.col("classified_ha") - F.col("unobserved_ha"))
        .withColumn(
            "balanced", (F.col("missing_ha") == 0) & (F.col("n_doubled") == 0) & (F.col("n_foreign") == 0)
        )
    )


def units_without_class(state: DataFrame, units: DataFrame, y0: int, y1: int) -> DataFrame:
    """Units and years with no class: not yet observed, or never observed at all."""
    never = units.join(state, "unit_id", "left_anti").select(
        "unit_id", F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("year")
    )
    not_yet = state.filter("land_use is null").select("unit_id", "year")
    return not_yet.withColumn("reason", F.lit("not yet observed")).unionByName(
        never.withColumn("reason", F.lit("never observed"))
    )


def all_carbon_check(entries: DataFrame, stocks: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Compare the change of each stock with the ledger's net flux of carbon since the stock before.

    Fluxes count towards the unit's next stock of the pool, so stocks may be
    years apart. Both sides are put under each other, which joins them fully
    with one shuffle; a unit and pool has few rows. ``status`` is ``balanced``,
    ``off``, ``no flux`` (the stock moved, the ledger has nothing) or ``no
    stock`` (fluxes up to the first stock or after the last one).
    """
    keys = ["unit_id", "year", "pool"]
    none = F.lit(None).cast(MONEY)
    held = stocks.select(*keys, F.col("stock").cast(MONEY).alias("stock"), none.alias("flux"))
    flows = entries.filter("gas = 'CO2'").select(*keys, none.alias("stock"), F.col("amount").alias("flux"))
    # dealt out once: sums and windows below all keep units and pools together
    rows = held.unionByName(flows).repartition("unit_id", "pool").groupBy(*keys)
    rows = rows.agg(F.sum("stock").cast(MONEY).alias("stock"), F.sum("flux").cast(MONEY).alias("flux"))
    own = Window.partitionBy("unit_id", "pool").orderBy("year")
    ahead = own.rangeBetween(0, Window.unboundedFollowing)
    stock_year = F.when(F.col("stock").isNotNull(), F.col("year"))
    rows = rows.withColumn("until", F.min(stock_year).over(ahead))
    zero = F.lit(0).cast(MONEY)
    grouped = rows.groupBy("unit_id", "pool", F.coalesce("until", "year").alias("year")).agg(
        F.sum("stock").alias("stock"), F.sum("flux").alias("flux")
    )
    before = F.last("stock", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    grouped = grouped.withColumn("stock_change", F.col("stock") - before)
    status = (
        F.when(F.col("stock_change").isNull(), "no stock")
        .when(F.abs("difference") <= tolerance, "balanced")
        .when(F.col("flux").isNull(), "no flux")
        .otherwise("off")
    )
    return (
        grouped.filter("stock_change is not null or flux is not null")
        .withColumn("difference", F.coalesce("stock_change", zero) - F.coalesce("flux", zero))
        .withColumn("status", status)
        .select(*keys, F.col("stock_change").cast(MONEY).alias("stock_change"), "flux", "difference", "status")
    )


def missing_pools(entries: DataFrame, stocks: DataFrame, units: DataFrame, pools: list[str]) -> DataFrame:
    """Units and pools of ``pools`` that have neither a stock nor a flux of carbon."""
    seen = entries.filter("gas = 'CO2'").select("unit_id", "pool").unionByName(stocks.select("unit_id", "pool"))
    held = [F.max(F.col("pool") == p).alias(f"_{p}") for p in pools]
    per_unit = units.select("unit_id").distinct().join(seen.groupBy("unit_id").agg(*held), "unit_id", "left")
    absent = [F.when(~F.coalesce(F.col(f"_{p}"), F.lit(False)), F.lit(p)) for p in pools]
    return per_unit.select("unit_id", F.explode(F.array_compact(F.array(*absent))).alias("pool"))


def unbooked_rows(
    rows: DataFrame, state: DataFrame, units: DataFrame, factor: DataFrame, params: list[str]
) -> DataFrame:
    """Unit-years of an input that lead to no ledger row, how many rows they hold, and why.

    ``reason`` is ``no unit`` (unknown to ``units``), ``no class`` (no land use
    that year) or ``no factor`` (one of ``params`` is missing); the first that
    holds is given.
    """
    seen = rows.groupBy("unit_id", "year").agg(F.count("*").alias("n_rows"))
    placed = seen.join(units.select("unit_id", "country_id", "zone", F.lit(True).alias("_unit")), "unit_id", "left")
    classed = placed.join(state.select("unit_id", "year", "land_use"), ["unit_id", "year"], "left")
    found = resolve_factors(classed, factor, params, names={p: f"_{p}" for p in params})
    lacking = F.lit(False)
    for p in params:
        lacking |= F.col(f"_{p}").isNull()
    reason = (
        F.when(F.col("_unit").isNull(), "no unit").when(F.col("land_use").isNull(), "no class").when(lacking, "no factor")
    )
    return found.withColumn("reason", reason).filter("reason is not null").select("unit_id", "year", "n_rows", "reason")


def double_count(claims: DataFrame) -> DataFrame:
    """Claims that share a day with another claim on their unit, and with how many.

    Both ends of a claim count as claimed. The others that overlap a claim are
    all those begun by its end, less those over before its start and itself;
    running counts per unit and day give both numbers, so no pairs are made and
    the window grows with the days, not with the claims.
    """
    # per claim: its own day of beginning, the day after its end, and its last day, which is only asked for
    marks = F.array(
        F.struct(F.col("start_date").alias("day"), F.lit(1).alias("b"), F.lit(0).alias("e")),
        F.struct(F.date_add("end_date", 1).alias("day"), F.lit(0).alias("b"), F.lit(1).alias("e")),
        F.struct(F.col("end_date").alias("day"), F.lit(0).alias("b"), F.lit(0).alias("e")),
    )
    window = (
        Window.partitionBy("unit_id")
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = (
        claims.select("unit_id", F.inline(marks))
        .groupBy("unit_id", "day")
        .agg(F.sum("b").alias("b"), F.sum("e").alias("e"))
        .select(
            "unit_id",
            "day",
            F.sum("b").over(window).alias("begun"),
            F.sum("e").over(window).alias("ended"),
        )
    )
    at_end = running.select("unit_id", F.col("day").alias("end_date"), "begun")
    at_start = running.select("unit_id", F.col("day").alias("start_date"), "ended")
    return (
        claims.join(at_end, ["unit_id", "end_date"])
        .join(at_start, ["unit_id", "start_date"])
        .withColumn("n_overlaps", F.col("begun") - F.col("ended") - 1)
        .filter("n_overlaps > 0")
        .select(*claims.columns, "n_overlaps")
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ledger rows added, removed or changed from run ``a`` to run ``b``.

    Grouping treats nulls as equal keys, so one shuffle does what a null-safe
    full join would.
    """
    keys = ["unit_id", "year", "pool", "process", "gas"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("_run"), "amount")

    def of(name: str) -> Column:
        return F.sum(F.when(F.col("_run") == name, F.col("amount")))

    change = (
        F.when(F.col("amount_a").isNull(), "added")
        .when(F.col("amount_b").isNull(), "removed")
        .when(F.col("amount_a") != F.col("amount_b"), "changed")
    )
    return (
        side(a, "a")
        .unionByName(side(b, "b"))
        .groupBy(*keys)
        .agg(of("a").alias("amount_a"), of("b").alias("amount_b"))
        .withColumn("change", change)
        .filter("change is not null")
    )


def rows_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whole rows of ``a`` that ``b`` lacks, counting repeats."""
    return a.exceptAll(b)


def rows_in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)
