"""Land representation: states, transitions, spells.

Windows here run over unit-years, never over raw observations: a unit has at
most one row per year after ``dominant_land_use``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from landflux.functions.amounts import fixed_sql, unfixed_sql
from landflux.sources.schemas import LAND_USES


def _by_unit() -> WindowSpec:
    return Window.partitionBy("unit_id").orderBy("year")


def dominant_land_use(obs: DataFrame, classes: list[str] = LAND_USES) -> DataFrame:
    """Per unit and year the class with most observed area, ties to the first name.

    One aggregate sums every class in its own column, so there is one shuffle
    and the map side already reduces a hot unit to one row per year. A class
    outside ``classes`` stops the job: reject such rows first.
    """
    names = sorted(classes)
    areas = (
        obs.selectExpr(
            "unit_id", "year(obs_date) as year", _known(names), f"{fixed_sql('area_ha')} as area"
        )
        .groupBy("unit_id", "year")
        .agg(*_class_sums(names))
    )
    area = unfixed_sql(_top(names))
    return areas.selectExpr("unit_id", "year", _largest(names), f"{area} as area_ha")


def _known(names: list[str]) -> str:
    """The class, stopping the job at one that is not listed."""
    listed = ", ".join(f"'{c}'" for c in names)
    return (
        f"case when land_use in ({listed}) then land_use "
        "else raise_error(concat('unknown land use: ', coalesce(land_use, 'null'))) end as land_use"
    )


def _class_sums(names: list[str]) -> list[Column]:
    return [F.expr(f"sum(area) filter (where land_use = '{c}') as _{c}") for c in names]


def _top(names: list[str]) -> str:
    return f"greatest({', '.join(f'_{c}' for c in names)})"


def _largest(names: list[str]) -> str:
    cases = " ".join(f"when _{c} = {_top(names)} then '{c}'" for c in names)
    return f"case {cases} end as land_use"


def transitions(state: DataFrame) -> DataFrame:
    """Previous and current class of each unit, one row per pair of successive states."""
    extra = ["area_ha"] if "area_ha" in state.columns else []
    return (
        state.filter("land_use is not null")
        .select(
            "unit_id",
            F.lag("year").over(_by_unit()).alias("year_from"),
            "year",
            F.lag("land_use").over(_by_unit()).alias("use_from"),
            F.col("land_use").alias("use_to"),
            *extra,
        )
        .filter("use_from is not null")
    )


def changes(state: DataFrame) -> DataFrame:
    """Transitions to another class, with the year of the unit's next change."""
    return (
        transitions(state)
        .filter("use_from <> use_to")
        .select(
            "unit_id",
            "year",
            "use_from",
            "use_to",
            F.lead("year").over(_by_unit()).alias("next_change"),
        )
    )


def transition_matrix(state: DataFrame, units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area from class to class; ``by`` adds the year or columns of ``units``."""
    keys = [*(by or []), "use_from", "use_to"]
    pairs = transitions(state).drop("area_ha")
    return (
        pairs.join(units, "unit_id")
        .groupBy(*keys)
        .agg(F.sum("area_ha").alias("area_ha"), F.count("*").alias("n_units"))
    )


def _spell_number() -> Column:
    return F.sum(F.col("_new").cast("int")).over(_by_unit())


def land_use_spells(state: DataFrame) -> DataFrame:
    """Runs of one class in successive rows of a unit."""
    changed = ~F.col("land_use").eqNullSafe(F.lag("land_use").over(_by_unit()))
    return (
        state.filter("land_use is not null")
        .select("unit_id", "year", "land_use", changed.alias("_new"))
        .withColumn("spell", _spell_number())
        .groupBy("unit_id", "spell", "land_use")
        .agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
        .withColumn("n_years", F.col("last_year") - F.col("first_year") + 1)
    )


def remaining_or_converted(state: DataFrame, period: int = 20) -> DataFrame:
    """Whether a unit-year counts as remaining in its class or as converted to it."""
    before = F.lag("land_use").over(_by_unit())
    is_change = F.col("_before").isNotNull() & (F.col("_before") != F.col("land_use"))
    changed = F.struct("year", F.col("_before").alias("use"))
    last = F.last(F.when(is_change, changed), ignorenulls=True).over(_by_unit())
    recent = F.col("_last").isNotNull() & (F.col("year") - F.col("_last.year") < period)
    return (
        state.filter("land_use is not null")
        .select("unit_id", "year", "land_use", before.alias("_before"))
        .withColumn("_last", last)
        .select(
            "unit_id",
            "year",
            "land_use",
            F.when(recent, F.col("_last.use")).otherwise(F.col("land_use")).alias("use_from"),
            F.when(recent, F.concat(F.lit("land converted to "), F.col("land_use")))
            .otherwise(F.concat(F.col("land_use"), F.lit(" remaining "), F.col("land_use")))
            .alias("category"),
        )
    )


def first_loss_year(state: DataFrame, land_use: str) -> DataFrame:
    """First year a unit left a class, and the class it went to."""
    return (
        transitions(state)
        .filter((F.col("use_from") == land_use) & (F.col("use_to") != land_use))
        .groupBy("unit_id")
        .agg(F.min("year").alias("loss_year"), F.min_by("use_to", "year").alias("use_to"))
    )


def return_transitions(state: DataFrame, within: int) -> DataFrame:
    """Units that left a class and were back in it after at most ``within`` years."""
    same_class = Window.partitionBy("unit_id", "land_use").orderBy("first_year")
    return (
        land_use_spells(state)
        .select(
            "unit_id",
            "land_use",
            (F.lag("last_year").over(same_class) + 1).alias("left_year"),
            F.col("first_year").alias("back_year"),
        )
        .withColumn("years_away", F.col("back_year") - F.col("left_year"))
        .filter(F.col("years_away") <= within)
    )


def _provider_classes(obs: DataFrame) -> DataFrame:
    """The one class each provider names for a unit-year; an unknown class stops the job."""
    areas = (
        obs.selectExpr(
            "unit_id",
            "provider_id",
            "year(obs_date) as year",
            _known(LAND_USES),
            f"{fixed_sql('area_ha')} as area",
        )
        .groupBy("unit_id", "provider_id", "year")
        .agg(*_class_sums(LAND_USES))
    )
    return areas.selectExpr("unit_id", "year", "provider_id", _largest(LAND_USES))


def _class_votes(obs: DataFrame) -> DataFrame:
    """Number of providers naming each class, one row per unit-year."""
    votes = [F.count(F.when(F.col("land_use") == c, 1)).alias(f"_{c}") for c in LAND_USES]
    return _provider_classes(obs).groupBy("unit_id", "year").agg(*votes)


def provider_confusion(obs: DataFrame) -> DataFrame:
    """Pairs of providers by the two classes they name for the same unit-year.

    The pairs are counted, not made: with n providers for one class and m for
    another there are n*m pairs, and n*(n-1)/2 within a class.
    """
    cells = [(a, b) for i, a in enumerate(LAND_USES) for b in LAND_USES[i:]]

    def pairs(a: str, b: str) -> Column:
        n, m = F.col(f"_{a}"), F.col(f"_{b}")
        return (n * (n - 1) / 2).cast("bigint") if a == b else n * m

    # summed before they are turned to rows: a year has one row of 21 counts
    sums = _class_votes(obs).groupBy("year").agg(
        *[F.sum(pairs(a, b)).alias(f"_{a}_{b}") for a, b in cells]
    )
    rows = [
        F.struct(F.lit(a).alias("use_a"), F.lit(b).alias("use_b"), F.col(f"_{a}_{b}").alias("pairs"))
        for a, b in cells
    ]
    return (
        sums.select("year", F.explode(F.array(*rows)).alias("r"))
        .select("year", "r.use_a", "r.use_b", "r.pairs")
        .filter("pairs > 0")
    )


def provider_agreement(obs: DataFrame) -> DataFrame:
    """Per provider: comparisons with other providers on the same unit-year, and agreements."""
    votes = _class_votes(obs)
    total = sum((F.col(f"_{c}") for c in LAND_USES[1:]), F.col(f"_{LAND_USES[0]}"))
    own = F.coalesce(*[F.when(F.col("land_use") == c, F.col(f"_{c}")) for c in LAND_USES])
    return (
        _provider_classes(obs)
        .join(votes, ["unit_id", "year"])
        .groupBy("provider_id")
        .agg(F.sum(total - 1).alias("compared"), F.sum(own - 1).alias("agreed"))
        .withColumn("agreement", F.try_divide(F.col("agreed").cast("double"), F.col("compared").cast("double")))
    )
