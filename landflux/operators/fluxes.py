"""Stocks and fluxes. Every function that says so returns ledger rows.

A row with no factor at any tier gives no ledger row; ``missing_factors`` lists
such keys. Event tables are summed per unit and year before anything is joined
to them, so a unit with very many events is reduced on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landflux.functions.amounts import CO2_PER_C, amount, amount_sql
from landflux.operators.factors import resolve_both, resolve_factors
from landflux.operators.land import changes, land_use_spells
from landflux.sources.schemas import LEDGER_COLUMNS, MONEY

ATTRIBUTES = ["country_id", "zone"]


def _unit_columns(units: DataFrame) -> DataFrame:
    return units.selectExpr("unit_id", *ATTRIBUTES, "cast(area_ha as double) as area")


def unit_years(state: DataFrame, units: DataFrame) -> DataFrame:
    """Unit-years with a class, with the unit's country, zone and area.

    What this function gave before may stand for ``state``: it is taken as it is.
    So several operators can read it stored.
    """
    if "area" in state.columns:
        return state
    known = state.filter("land_use is not null").select("unit_id", "year", "land_use")
    return known.join(_unit_columns(units), "unit_id")


def unit_changes(state: DataFrame, units: DataFrame) -> DataFrame:
    """Changes of class with the unit's country, zone and area; its own result is taken as it is."""
    if "next_change" in state.columns:
        return state
    return changes(state).join(_unit_columns(units), "unit_id")


def _before_and_after(df: DataFrame, factor: DataFrame, params: list[str]) -> DataFrame:
    return resolve_both(df, factor, params, {"use_from": "from", "use_to": "to"})


def _legacy_years(period: int, until: int) -> str:
    """Years a change acts in: ``period`` of them, cut at the unit's next change.

    For changes up to ``until`` only: callers leave later ones out.
    """
    return (
        f"explode(sequence(year, least(year + {period - 1}, "
        f"coalesce(next_change - 1, {until}), {until}))) as year"
    )


def _part(pool: str, value: str, gas: str = "CO2") -> str:
    """One ledger row of an entry: ``pool`` is a name or, after ``=``, a column."""
    pool = pool[1:] if pool.startswith("=") else f"'{pool}'"
    unit = "tC" if gas == "CO2" else "t gas"
    return f"struct({pool} as pool, '{gas}' as gas, {amount_sql(value)} as amount, '{unit}' as unit)"


def _entries(df: DataFrame, process: str, parts: list[str]) -> DataFrame:
    return (
        df.selectExpr("unit_id", "cast(year as int) as year", f"inline(array({', '.join(parts)}))")
        .filter("amount is not null")
        .selectExpr(
            "unit_id", "year", "pool", f"'{process}' as process", "gas", "amount", "unit"
        )
    )


def biomass_gain(state: DataFrame, units: DataFrame, factor: DataFrame) -> DataFrame:
    """Ledger rows: yearly growth of biomass above and below ground."""
    df = resolve_factors(
        unit_years(state, units), factor, ["growth", "root_ratio", "carbon_fraction"]
    )
    above = "area * growth * carbon_fraction"
    return _entries(df, "growth", [_part("AGB", above), _part("BGB", f"{above} * root_ratio")])


def harvest_carbon(disturbance: DataFrame, units: DataFrame, factor: DataFrame) -> DataFrame:
    """Carbon above ground in the wood cut per unit and year, with its factors; its own result is taken as it is."""
    if "carbon" in disturbance.columns:
        return disturbance
    cut = (
        disturbance.filter("kind = 'harvest'")
        .selectExpr("unit_id", "year(event_date) as year", "volume_m3")
        .groupBy("unit_id", "year")
        .agg(F.expr("cast(sum(volume_m3) as double) as volume"))
        # nothing is booked without a volume; and as the factor keys need it too, both read one shuffle
        .filter("volume is not null")
        .join(_unit_columns(units), "unit_id")
        .withColumn("land_use", F.lit("forest"))
    )
    params = [
        "expansion",
        "root_ratio",
        "carbon_fraction",
        "product_share",
        "product_decay",
        "debris_share",
        "debris_years",
    ]
    df = resolve_factors(cut, factor, params)
    return df.withColumn("carbon", F.expr("volume * expansion * carbon_fraction"))


def harvest_loss(disturbance: DataFrame, units: DataFrame, factor: DataFrame) -> DataFrame:
    """Ledger rows: biomass lost to harvest."""
    return _entries(
        harvest_carbon(disturbance, units, factor),
        "harvest",
        [_part("AGB", "-carbon"), _part("BGB", "-carbon * root_ratio")],
    )


def entries(df: DataFrame, process: str, parts: list[tuple[str, str]]) -> DataFrame:
    """Ledger rows of carbon from columns: (pool, expression) for each row of ``df``."""
    return _entries(df, process, [_part(pool, value) for pool, value in parts])


def fire_severity(disturbance: DataFrame) -> DataFrame:
    """Severity of all fires of a unit and year, which add up to at most 1."""
    return (
        disturbance.filter("kind = 'fire'")
        .selectExpr("unit_id", "year(event_date) as year", f"cast(severity as {MONEY}) as severity")
        .groupBy("unit_id", "year")
        .agg(F.expr("cast(sum(severity) as double) as total"))
        .filter("total is not null")
        .selectExpr("unit_id", "year", "least(total, 1D) as severity")
    )


def burned_units(disturbance: DataFrame, state: DataFrame, units: DataFrame) -> DataFrame:
    """Unit-years with fire; severities of one year add up to at most 1."""
    return unit_years(state, units).join(fire_severity(disturbance), ["unit_id", "year"])


_BURNT = "-(area * biomass * severity)"
_FIRE_CARBON = [_part("AGB", _BURNT), _part("BGB", f"{_BURNT} * root_ratio")]
_FIRE_GASES = [
    _part("AGB", f"-(area * severity * fuel * combustion * fire_{gas} * 0.001D)", gas) for gas in ("CH4", "N2O")
]
_CARBON_FACTORS = ["biomass", "root_ratio"]
_GAS_FACTORS = ["fuel", "combustion", "fire_CH4", "fire_N2O"]


def _fires(disturbance, state, units, factor, params: list[str], parts: list[str]) -> DataFrame:
    df = resolve_factors(burned_units(disturbance, state, units), factor, params)
    return _entries(df, "fire", parts)


def disturbance_loss(
    disturbance: DataFrame, state: DataFrame, units: DataFrame, factor: DataFrame
) -> DataFrame:
    """Ledger rows: biomass lost to fire, never more than the stock."""
    return _fires(disturbance, state, units, factor, _CARBON_FACTORS, _FIRE_CARBON)


def fire_non_co2(
    disturbance: DataFrame, state: DataFrame, units: DataFrame, factor: DataFrame
) -> DataFrame:
    """Ledger rows: methane and nitrous oxide from fires, in tonnes of gas."""
    return _fires(disturbance, state, units, factor, _GAS_FACTORS, _FIRE_GASES)


def fire_fluxes(disturbance: DataFrame, state: DataFrame, units: DataFrame, factor: DataFrame) -> DataFrame:
    """Ledger rows: ``disturbance_loss`` and ``fire_non_co2`` in one pass over the fires."""
    return _fires(disturbance, state, units, factor, _CARBON_FACTORS + _GAS_FACTORS, _FIRE_CARBON + _FIRE_GASES)


def gain_loss(ledger: DataFrame) -> DataFrame:
    """Gains, losses and their difference per unit, year and pool."""
    return (
        ledger.filter("gas = 'CO2'")
        .groupBy("unit_id", "year", "pool")
        .agg(*_gains_and_losses(), F.sum("amount").alias("net"))
    )


def _gains_and_losses(gain: str = "gains", loss: str = "losses") -> list[Column]:
    zero = F.lit(0).cast(MONEY)
    return [
        F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(zero)).alias(gain),
        F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(zero)).alias(loss),
    ]


def stock_difference(surveys: DataFrame, units: DataFrame) -> DataFrame:
    """Yearly stock change between successive surveys of a unit.

    ``surveys`` has one row per unit and day: run ``latest_per_key`` first.
    """
    window = Window.partitionBy("unit_id").orderBy("survey_date")
    days = F.datediff("survey_date", "from_date")
    change = (F.col("c_density") - F.col("_before")) / (days / F.lit(365.25)) * F.col("area")
    return (
        surveys.select(
            "unit_id",
            F.lag("survey_date").over(window).alias("from_date"),
            "survey_date",
            F.lag("c_density").over(window).alias("_before"),
            "c_density",
        )
        .filter("from_date is not null")
        .join(_unit_columns(units), "unit_id")
        .select(
            "unit_id",
            "from_date",
            F.col("survey_date").alias("to_date"),
            days.alias("days"),
            amount(change).alias("amount"),
        )
    )


def conversion_biomass(state: DataFrame, units: DataFrame, factor: DataFrame) -> DataFrame:
    """Ledger rows: biomass after minus before, above and below ground, in the year of a change."""
    df = _before_and_after(unit_changes(state, units), factor, ["biomass", "root_ratio"])
    below = "(biomass_to * root_ratio_to - biomass_from * root_ratio_from) * area"
    return _entries(
        df, "conversion", [_part("AGB", "(biomass_to - biomass_from) * area"), _part("BGB", below)]
    )


def dom_conversion(
    state: DataFrame, units: DataFrame, factor: DataFrame, period: int, until: int
) -> DataFrame:
    """Ledger rows: dead wood and litter moving to the new class's level over ``period`` years.

    Nothing is booked after ``until``; changes later than that are left out.
    """
    known = unit_changes(state, units).filter(F.col("year") <= until)
    df = _before_and_after(known, factor, ["dead_wood", "litter"])
    df = df.selectExpr(
        "unit_id",
        f"(dead_wood_to - dead_wood_from) * area / {period}D as dw",
        f"(litter_to - litter_from) * area / {period}D as litter",
        _legacy_years(period, until),
    )
    return _entries(df, "conversion", [_part("DW", "dw"), _part("LITTER", "litter")])


SOIL = ["soc_ref", "soc_land_use", "soc_management", "soc_input"]


def soil_mineral(
    state: DataFrame, units: DataFrame, factor: DataFrame, until: int, period: int = 20
) -> DataFrame:
    """Ledger rows: mineral soil moving to the new class's level over ``period`` years.

    Nothing is booked after ``until``; changes later than that are left out.
    """
    known = unit_changes(state, units).filter(F.col("year") <= until)
    df = _before_and_after(known, factor, SOIL)
    now, before = (" * ".join(f"{p}_{side}" for p in SOIL) for side in ("to", "from"))
    df = df.selectExpr(
        "unit_id", f"({now} - {before}) * area / {period}D as soc", _legacy_years(period, until)
    )
    return _entries(df, "conversion", [_part("SOC", "soc")])


def soil_organic(state: DataFrame, units: DataFrame, factor: DataFrame) -> DataFrame:
    """Ledger rows: carbon lost from drained organic soil."""
    df = resolve_factors(unit_years(state, units), factor, ["organic_share", "organic_drainage"])
    df = df.filter("organic_drainage > 0")
    return _entries(df, "drainage", [_part("SOC", "-(area * organic_share * organic_drainage)")])


def soil_n2o_direct(
    n_input: DataFrame, state: DataFrame, units: DataFrame, factor: DataFrame
) -> DataFrame:
    """Ledger rows: nitrous oxide from nitrogen put on soils, in tonnes of gas."""
    df = resolve_factors(
        unit_years(state, units).join(n_input, ["unit_id", "year"]), factor, ["n2o_direct"]
    )
    gas = "-(cast(n_tonnes as double) * n2o_direct * (44D / 28D))"
    return _entries(df, "nitrogen", [_part("SOC", gas, "N2O")])


# Share of a year's inflow that still stands at that year's end.
STANDING = "(case when product_decay = 0 then 1D else (1 - exp(-product_decay)) / product_decay end)"


# Share of debris that is left after a year; debris that lasts no time is gone.
LEFT_A_YEAR = "(case when debris_years = 0 then 0D else exp(-1 / debris_years) end)"


def hwp_pool(harvest: DataFrame, until: int, by: str = "country_id") -> DataFrame:
    """Carbon in wood products per ``by`` and year up to ``until``, and its yearly change.

    ``harvest`` is ``harvest_carbon``; harvests after ``until`` are left out.
    Inflows are summed per year, then each inflow year is listed under the years
    it still stands in. Without decay an inflow stands for ever.
    """
    k = "product_decay"
    left = f"cast(inflow as double) * exp(-{k} * (year - from_year)) * {STANDING}"
    window = Window.partitionBy(by).orderBy("year")
    return (
        harvest.filter(F.col("year") <= until)
        .selectExpr(by, "year", k, f"{amount_sql('carbon * product_share')} as c")
        .groupBy(by, "year", k)
        .agg(F.sum("c").alias("inflow"))
        .selectExpr(by, "year as from_year", "inflow", k, f"explode(sequence(year, {until})) as year")
        .groupBy(by, "year")
        .agg(F.expr(f"sum({amount_sql(left)}) as stock"))
        .withColumn("change", F.col("stock") - F.coalesce(F.lag("stock").over(window), F.lit(0)))
    )


def harvest_gains(harvest: DataFrame) -> DataFrame:
    """Ledger rows: what a harvest moves on, to dead wood (debris) and to products.

    The other side of ``harvest_loss``; what neither gains is emitted at once. A
    pool gains only what it can lose again: without a factor for its decay there
    is no row, and ``missing_factors`` lists the key.
    """
    debris = "case when debris_years is not null then carbon * debris_share end"
    products = "case when product_decay is not null then carbon * product_share end"
    return _entries(harvest, "harvest", [_part("DW", debris), _part("HWP", products)])


def product_decay(harvest: DataFrame, until: int) -> DataFrame:
    """Ledger rows: carbon that leaves the products, by unit; the losses of ``hwp_pool``."""
    k = "product_decay"
    age = "(year - from_year)"
    lost = (
        f"case when {age} = 0 then 1 - {STANDING} "
        f"else {STANDING} * (exp(-{k} * ({age} - 1)) - exp(-{k} * {age})) end"
    )
    df = harvest.filter(F.col("year") <= until).selectExpr(
        "unit_id", "carbon * product_share as inflow", k, "year as from_year", f"explode(sequence(year, {until})) as year"
    )
    return _sum_entries(_entries(df, "decay", [_part("HWP", f"-(inflow * ({lost}))")]))


def harvest_stocks(harvest: DataFrame, until: int) -> DataFrame:
    """Stocks of harvested carbon per unit and year up to ``until``: debris in DW, products in HWP."""
    age = "(year - from_year)"
    left = f"case when debris_years = 0 then 0D else exp(-({age} + 1) / debris_years) end"
    debris = amount_sql(f"carbon * debris_share * ({left})")
    products = amount_sql(f"carbon * product_share * exp(-product_decay * {age}) * {STANDING}")
    return (
        harvest.filter(F.col("year") <= until)
        .selectExpr("*", "year as from_year")
        .withColumn("year", F.expr(f"explode(sequence(from_year, {until}))"))
        .selectExpr(
            "unit_id",
            "year",
            f"inline(array(struct('DW' as pool, {debris} as stock), struct('HWP' as pool, {products} as stock)))",
        )
        .groupBy("unit_id", "year", "pool")
        .agg(F.sum("stock").cast(MONEY).alias("stock"))
    )


def rewetting_ch4(state: DataFrame, units: DataFrame, factor: DataFrame) -> DataFrame:
    """Ledger rows: methane of organic soil that was dry before and is wetland now."""
    rewetted = (
        land_use_spells(state)
        .filter("land_use = 'wetland' and spell > 1")
        .selectExpr("unit_id", "land_use", "explode(sequence(first_year, last_year)) as year")
    )
    df = resolve_factors(
        unit_years(rewetted, units), factor, ["organic_share", "rewetting_CH4"]
    )
    gas = "-(area * organic_share * rewetting_CH4)"
    return _entries(df, "rewetting", [_part("SOC", gas, "CH4")])


def delayed_decay(harvest: DataFrame, until: int) -> DataFrame:
    """Ledger rows: harvest debris lost over the years after the event.

    Nothing is booked after ``until``; harvests later than that are left out.
    ``harvest_gains`` books the debris that comes in.
    """
    df = harvest.filter(F.col("year") <= until).selectExpr(
        "unit_id",
        "carbon * debris_share as debris",
        "debris_years",
        "year as from_year",
        f"explode(sequence(year, {until})) as year",
    )
    share = (
        "case when debris_years = 0 then if(year = from_year, 1D, 0D) "
        "else exp(-(year - from_year) / debris_years) - exp(-(year - from_year + 1) / debris_years) end"
    )
    return _sum_entries(_entries(df.withColumn("share", F.expr(share)), "decay", [_part("DW", "-(debris * share)")]))


def bookkeeping(state: DataFrame, units: DataFrame, curves: DataFrame, until: int) -> DataFrame:
    """Ledger rows: each change follows its response curve until the unit's next change."""
    df = (
        unit_changes(state, units)
        .join(curves, F.expr("use_from = from_use and use_to = to_use"))
        .filter(f"year + age <= least(coalesce(next_change - 1, {until}), {until})")
        .withColumn("year", F.expr("year + age"))
    )
    return _sum_entries(_entries(df, "legacy", [_part("=pool", "area * share")]))


def _sum_entries(entries: DataFrame) -> DataFrame:
    keys = [c for c in LEDGER_COLUMNS if c != "amount"]
    return (
        entries.groupBy(*keys)
        .agg(F.sum("amount").cast(MONEY).alias("amount"))
        .select(*LEDGER_COLUMNS)
    )


def ledger(*parts: DataFrame) -> DataFrame:
    """All parts under one schema."""
    out = parts[0].select(*LEDGER_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*LEDGER_COLUMNS))
    return out


def co2e(entries: DataFrame, gwp: DataFrame, gwp_set: str) -> DataFrame:
    """Add ``co2e`` in tonnes, emissions positive, by one set of warming potentials.

    A gas that the set lacks stops the job.
    """
    return entries.join(_potentials(gwp, gwp_set), "gas", "left").withColumn("co2e", amount(-_tonnes_co2e())).drop("_gwp")


def in_co2e(entries: DataFrame, gwp: DataFrame, gwp_set: str) -> DataFrame:
    """The ledger with every amount in tonnes of CO2-equivalent, gains still positive.

    Reports add amounts of one unit only; this brings all gases to one.
    """
    joined = entries.join(_potentials(gwp, gwp_set), "gas", "left").withColumn("amount", amount(_tonnes_co2e()))
    return joined.withColumn("unit", F.lit("t CO2e")).select(entries.columns)


def _potentials(gwp: DataFrame, gwp_set: str) -> DataFrame:
    return gwp.filter(F.col("gwp_set") == gwp_set).select("gas", F.col("value").alias("_gwp"))


def _tonnes_co2e() -> Column:
    tonnes = F.col("amount").cast("double") * F.when(F.col("gas") == "CO2", F.lit(CO2_PER_C)).otherwise(1.0)
    unknown = F.raise_error(F.concat(F.lit("no warming potential for "), F.coalesce("gas", F.lit("null")))).cast("double")
    return tonnes * F.when(F.col("_gwp").isNotNull(), F.col("_gwp")).otherwise(unknown)


def gross_and_net(entries: DataFrame, by: list[str]) -> DataFrame:
    """Gross removals and emissions of carbon, and their difference."""
    return (
        entries.filter("gas = 'CO2'")
        .groupBy(*by)
        .agg(*_gains_and_losses("removals", "emissions"), F.sum("amount").alias("net"))
    )
