"""Reports over the ledger.

Each report first sums the ledger to the report's own keys, so windows run over
regions, countries, categories and years. Sums over all keys are kept in ranges
(``scans.running_total``) or as one number, so keys may be as many as they like.

Amounts are added within one unit only: a sum over two units stops the job.
Bring a ledger of several gases to one by ``fluxes.in_co2e``, or filter one gas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landflux.operators.quantiles import exact_quantiles
from landflux.operators.scans import ranged, running_total
from landflux.session import keep
from landflux.sources.schemas import MONEY

def with_region(entries: DataFrame, units: DataFrame, country: DataFrame) -> DataFrame:
    """Ledger rows with country, zone and region; a unit without them keeps its rows."""
    place = units.join(country, "country_id", "left").select(
        "unit_id", "country_id", "country", "zone", "region_id", "region"
    )
    return entries.join(place, "unit_id", "left")


def _one_unit(value: Column, low: Column, high: Column) -> Column:
    mixed = F.raise_error(F.concat(F.lit("amounts in "), low, F.lit(" and "), high, F.lit(" are not added")))
    return F.when(low.eqNullSafe(high), value).otherwise(mixed.cast(MONEY))


def _by_unit(entries: DataFrame, by: list[str]) -> DataFrame:
    """The amounts summed to ``by`` and their unit, as ``_amount`` and ``_unit``.

    The unit is a key here, so the rows are summed by hash within each task; the
    least and greatest unit, which would sort them, are taken of the sums.
    """
    return entries.groupBy(*by, F.col("unit").alias("_unit")).agg(F.sum("amount").alias("_amount"))


def _sum(sums: DataFrame) -> Column:
    """The sum of ``_by_unit``'s amounts, if all have one unit."""
    total = F.sum("_amount").cast(sums.schema["_amount"].dataType)
    return _one_unit(total, F.min("_unit"), F.max("_unit")).alias("amount")


def totals(entries: DataFrame, by: list[str]) -> DataFrame:
    sums = _by_unit(entries, by)
    return sums.groupBy(*by).agg(_sum(sums))


def _all_totals(entries: DataFrame, by: list[str]) -> DataFrame:
    """Totals that are compared with each other, written once in descending order of size.

    All groups must have one unit.
    """
    sums = _by_unit(entries, by)
    total = F.sum("_amount").cast(sums.schema["_amount"].dataType).alias("_amount")
    sums = sums.groupBy(*by).agg(total, F.min("_unit").alias("_l"), F.max("_unit").alias("_h"))
    sums = sums.withColumn("size", F.abs("_amount"))
    placed = ranged(sums, [F.col("size").desc(), *[F.col(c) for c in by]], "totals")
    low, high = placed.agg(F.min("_l")).scalar(), placed.agg(F.max("_h")).scalar()
    return placed.select(*by, _one_unit(F.col("_amount"), low, high).alias("amount"), "size", "_pos")


def report_rollup(entries: DataFrame, dims: list[str]) -> DataFrame:
    sums = _by_unit(entries, dims)
    return sums.rollup(*dims).agg(F.grouping_id().alias("level"), _sum(sums))


def report_cube(entries: DataFrame, dims: list[str]) -> DataFrame:
    sums = _by_unit(entries, dims)
    return sums.cube(*dims).agg(F.grouping_id().alias("level"), _sum(sums))


def report_sets(entries: DataFrame, sets: list[list[str]], dims: list[str]) -> DataFrame:
    """Subtotals for the named sets of ``dims`` only."""
    sums = _by_unit(entries, dims)
    columns = [[F.col(c) for c in s] for s in sets]
    return sums.groupingSets(columns, *dims).agg(F.grouping_id().alias("level"), _sum(sums))


def cumulative_flux(entries: DataFrame, by: list[str], first_year: int) -> DataFrame:
    window = (
        Window.partitionBy(*by)
        .orderBy("year")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    yearly = totals(entries.filter(F.col("year") >= first_year), [*by, "year"])
    return yearly.withColumn("cumulative", F.sum("amount").over(window))


def moving_mean(entries: DataFrame, by: list[str], n: int) -> DataFrame:
    """Mean over the last ``n`` calendar years, of those that are there."""
    window = Window.partitionBy(*by).orderBy("year").rangeBetween(-(n - 1), 0)
    mean = F.sum("amount").over(window).cast("double") / F.count("amount").over(window)
    return totals(entries, [*by, "year"]).withColumn("moving_mean", mean)


def versus_baseline(entries: DataFrame, by: list[str], y0: int, y1: int) -> DataFrame:
    """Difference from the mean of the reference years."""
    window = Window.partitionBy(*by)
    inside = F.when(F.col("year").between(y0, y1), F.col("amount"))
    mean = F.try_divide(
        F.sum(inside).over(window).cast("double"), F.count(inside).over(window).cast("double")
    )
    return (
        totals(entries, [*by, "year"])
        .withColumn("baseline", mean)
        .withColumn("difference", F.col("amount").cast("double") - F.col("baseline"))
    )


def year_on_year(entries: DataFrame, by: list[str]) -> DataFrame:
    """Change from the calendar year before; null where that year is missing."""
    window = Window.partitionBy(*by).orderBy("year").rangeBetween(-1, -1)
    before = F.max("amount").over(window)
    change = (F.col("amount") - F.col("before")).cast("double")
    return (
        totals(entries, [*by, "year"])
        .withColumn("before", before)
        .withColumn("change", change)
        .withColumn("relative", F.try_divide(F.col("change"), F.abs("before").cast("double")))
    )


def top_emitters(
    entries: DataFrame, k: int, by: str, item: str, keep_ties: bool = False
) -> DataFrame:
    """The ``k`` items that lose most carbon in each ``by``.

    The filter on the rank lets Spark keep k rows per ``by`` and map partition
    before the shuffle.
    """
    order = [F.col("amount").asc()] if keep_ties else [F.col("amount").asc(), F.col(item).asc()]
    window = Window.partitionBy(by).orderBy(*order)
    place = F.rank() if keep_ties else F.row_number()
    return (
        totals(entries, [by, item])
        .withColumn("place", place.over(window))
        .filter(F.col("place") <= k)
    )


def key_categories(entries: DataFrame, by: list[str], share: float = 0.95) -> DataFrame:
    """Largest categories by absolute amount that together reach ``share`` of the total."""
    placed = _all_totals(entries, by)
    total = placed.agg(F.sum("size")).scalar().cast("double")
    return (
        running_total(placed, "size", "_upto")
        .withColumn("cumulative_share", F.try_divide(F.col("_upto").cast("double"), total))
        .withColumn("own_share", F.try_divide(F.col("size").cast("double"), total))
        .filter(F.col("cumulative_share") - F.col("own_share") < share - 1e-9)
        .drop("_upto", "_pos")
    )


def trend(entries: DataFrame, by: list[str]) -> DataFrame:
    """Slope per year, intercept and r2 of the yearly totals."""
    y, x = F.col("amount").cast("double"), F.col("year").cast("double")
    return (
        totals(entries, [*by, "year"])
        .groupBy(*by)
        .agg(
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"),
        )
    )


APPROX_ERROR = 0.02  # relative standard error of approximate counts
QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def distribution(
    entries: DataFrame, by: list[str], probs: dict[str, float] | None = None
) -> DataFrame:
    """Exact percentiles of unit totals in each ``by``."""
    unit_totals = keep(totals(entries, [*by, "unit_id"]), "unit-totals")
    probs = probs or {"p05": 0.05, **QUARTILES, "p95": 0.95}
    return exact_quantiles(unit_totals, by, "amount", probs)


def unit_quartiles(entries: DataFrame, by: list[str]) -> DataFrame:
    """The quarter of its group each unit's total falls in; equal totals share one."""
    unit_totals = keep(totals(entries, [*by, "unit_id"]), "unit-totals")
    cuts = exact_quantiles(unit_totals, by, "amount", QUARTILES).withColumnsRenamed({c: f"_c_{c}" for c in by})
    value = F.col("amount").cast("double")
    quartile = (
        F.when(value <= F.col("p25"), 1)
        .when(value <= F.col("median"), 2)
        .when(value <= F.col("p75"), 3)
        .otherwise(4)
    )
    match = F.lit(True)
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return unit_totals.join(cuts, match).select(*by, "unit_id", "amount", quartile.alias("quartile"))


def _seen(obs: DataFrame) -> DataFrame:
    """The distinct units and providers of each year, each in rows of its own."""
    of_unit = F.col("_of_unit")
    year = F.year("obs_date").alias("year")
    listed = obs.select(year, "unit_id", "provider_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("_of_unit"))
    unit, provider = F.when(of_unit, F.col("unit_id")), F.when(~of_unit, F.col("provider_id"))
    return listed.select("year", "_of_unit", unit.alias("unit_id"), provider.alias("provider_id")).distinct()


def coverage(obs: DataFrame) -> DataFrame:
    """Units and providers seen in each year, exactly and approximately.

    Repeats are dropped by hash, units and providers apart; then each year is
    counted in one pass, so a sketch is held per year and task, never per unit.
    """
    seen = _seen(obs)
    return seen.groupBy("year").agg(
        F.count("unit_id").alias("n_units"),
        F.count("provider_id").alias("n_providers"),
        F.approx_count_distinct("unit_id", APPROX_ERROR).alias("approx_units"),
    )


def counts_of_spans(obs: DataFrame, spans: DataFrame) -> DataFrame:
    """Units and providers seen in each span (first_year, last_year), exactly.

    A span counts a unit at the first of its years that lies within: the one
    whose year before it, ``_before``, lies ahead of the span or is not there.
    So the rows are summed to pairs of years before they meet any span. A span
    without a row has none here.
    """
    seen = _seen(obs).filter("year is not null")
    before = F.lag("year").over(Window.partitionBy("_of_unit", "unit_id", "provider_id").orderBy("year"))
    pairs = seen.withColumn("_before", before).groupBy("year", "_before").agg(
        F.count("unit_id").alias("_units"), F.count("provider_id").alias("_providers")
    )
    years = spans.distinct().withColumn("year", F.explode(F.sequence("first_year", "last_year")))
    return (
        years.join(pairs, "year")
        .filter("_before is null or _before < first_year")
        .groupBy("first_year", "last_year")
        .agg(F.sum("_units").alias("n_units"), F.sum("_providers").alias("n_providers"))
    )


def share_of_total(entries: DataFrame, by: str, within: str) -> DataFrame:
    """Share of each ``by`` in its ``within`` and in the whole."""
    placed = _all_totals(entries, [within, by])
    whole = placed.agg(F.sum("amount")).scalar().cast("double")
    part = placed.groupBy(F.col(within).alias("_within")).agg(F.sum("amount").cast("double").alias("_part"))
    amount = F.col("amount").cast("double")
    return (
        placed.join(part, F.col(within).eqNullSafe(F.col("_within")))
        .withColumn("share_within", F.try_divide(amount, F.col("_part")))
        .withColumn("share_world", F.try_divide(amount, whole))
        .select(within, by, "amount", "share_within", "share_world")
    )
