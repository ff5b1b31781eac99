"""Factor resolution: by specificity and validity, and the latest survey before a date."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landflux.operators.prepare import latest_per_key

SCOPE = ["country_id", "zone", "land_use"]
# Scopes from specific to general: more keys first; among equal numbers country
# goes before zone and zone before class. A scope's tier is its place, from 1.
SCOPES = [list(keys) for n in (3, 2, 1, 0) for keys in combinations(SCOPE, n)]
TIER_OF = {tuple(keys): number for number, keys in enumerate(SCOPES, start=1)}


# Years 1500 to 2523 lie in a tree of cells: level l has cells of 4**l years, the
# top level one cell for all. Years outside, and no year, have a cell each.
FIRST, LEVELS = 1500, 6
SPAN = 4 ** (LEVELS - 1)
BELOW, ABOVE, NO_YEAR = -1, -2, -3


def _cells_of_year(year: Column) -> Column:
    """The cells a year is looked up under: one of each level."""
    at = year.cast("int") - FIRST
    inside = F.array(*[F.lit(level * SPAN) + F.shiftright(at, 2 * level) for level in range(LEVELS)])
    return (
        F.when(year.isNull(), F.array(F.lit(NO_YEAR)))
        .when(at < 0, F.array(F.lit(BELOW)))
        .when(at >= SPAN, F.array(F.lit(ABOVE)))
        .otherwise(inside)
    )


def _with_cells_of_range(rows: DataFrame, low: str, high: str) -> DataFrame:
    """``rows`` once for each of the fewest cells, ``_cell``, that make up a range of years.

    At most six cells a level; a null end is open.
    """
    last = FIRST + SPAN - 1
    listed = rows.selectExpr(
        "*",
        f"greatest(coalesce(cast({low} as int), {FIRST}), {FIRST}) - {FIRST} as _start",
        f"least(coalesce(cast({high} as int), {last}), {last}) - {FIRST} + 1 as _stop",
        f"explode(sequence({NO_YEAR}, {LEVELS - 1})) as _level",
    )
    # first and last cell of the level, and of the one above, that lie within the range
    bits, up = "2 * _level", "2 * _level + 2"
    listed = listed.selectExpr(
        "*",
        f"shiftright(_start + shiftleft(1, {bits}) - 1, {bits}) as _a",
        f"shiftright(_stop, {bits}) - 1 as _b",
        f"shiftright(_start + shiftleft(1, {up}) - 1, {up}) * 4 as _c",
        f"shiftright(_stop, {up}) * 4 - 1 as _d",
    )
    cells = f"""case
        when _level = {NO_YEAR}
          or _level = {BELOW} and ({low} is null or {low} < {FIRST})
          or _level = {ABOVE} and ({high} is null or {high} > {last}) then array(_level)
        when _level < 0 then null
        when _c > _d then if(_a <= _b, transform(sequence(_a, _b), x -> x + _level * {SPAN}), null)
        else transform(filter(sequence(_a, _b), x -> x < _c or x > _d), x -> x + _level * {SPAN})
    end"""
    return listed.withColumn("_cell", F.explode(F.expr(cells))).drop("_start", "_stop", "_level", "_a", "_b", "_c", "_d")


def _indexed(factor: DataFrame, params: list[str]) -> DataFrame:
    """The best factor of every parameter for each scope and cell of years, as structs ``_<param>``.

    However many validities a scope has, a cell keeps one choice. Only the cells
    outside the tree keep the ends apart, since they hold years that differ.
    """
    began = F.coalesce(-F.col("valid_from").cast("bigint"), F.lit(1 << 40))
    ended = F.coalesce(F.col("valid_to").cast("bigint"), F.lit(1 << 40))
    choice = F.struct(began.alias("b"), ended.alias("e"), "value", F.col("rel_unc").alias("unc"))
    outside = F.col("_cell").isin(BELOW, ABOVE)
    cells = _with_cells_of_range(factor.filter(F.col("param").isin(params)), "valid_from", "valid_to")
    return cells.groupBy(
        *[F.col(k).alias(f"_f_{k}") for k in SCOPE],
        "_cell",
        F.when(outside, F.col("valid_from")).alias("_from"),
        F.when(outside, F.col("valid_to")).alias("_to"),
    ).agg(*[F.min(F.when(F.col("param") == p, choice)).alias(f"_{p}") for p in params])


def tiers_with(key: str) -> list[int]:
    """Tiers whose scope names ``key``."""
    return [number for keys, number in TIER_OF.items() if key in keys]


def _best(keys: DataFrame, factor: DataFrame, params: list[str], have: list[str]) -> DataFrame:
    """For distinct keys the factor of each parameter, as one struct column ``_<param>``.

    A key is listed once under every scope it can be found by and every cell of
    years that holds its year, and meets the factors of that scope and cell in
    one null-safe join on equal keys: at most ``len(SCOPES) * LEVELS`` candidates,
    however many validities there are. An open end holds always. Then the lowest
    tier wins, then the range that began last. Rows that tie in both are told
    apart by their end, value and uncertainty, so that value and uncertainty come
    from one row. A null year finds the range that began last of all.
    """
    scopes = []
    for scope, tier in TIER_OF.items():
        if set(scope) <= set(have):
            fields = [
                F.when(F.lit(k in scope), F.col(f"_k_{k}")).alias(f"_s_{k}")
                if k in have
                else F.lit(None).cast(factor.schema[k].dataType).alias(f"_s_{k}")
                for k in SCOPE
            ]
            known = F.lit(True)
            for k in scope:
                known = known & F.col(f"_k_{k}").isNotNull()
            scopes.append(F.when(known, F.struct(F.lit(tier).alias("_tier"), *fields)))
    listed = keys.withColumn("_scope", F.explode(F.array_compact(F.array(*scopes))))
    listed = listed.select(*keys.columns, "_scope.*", F.explode(_cells_of_year(F.col("_k_year"))).alias("_at"))
    match = F.col("_at") == F.col("_cell")
    match &= F.coalesce(F.col("_k_year") >= F.col("_from"), F.lit(True))
    match &= F.coalesce(F.col("_k_year") <= F.col("_to"), F.lit(True))
    for k in SCOPE:
        match &= F.col(f"_s_{k}").eqNullSafe(F.col(f"_f_{k}"))
    picks = []
    for p in params:
        found = F.struct(F.col("_tier").alias("tier"), *[F.col(f"_{p}.{c}").alias(c) for c in ("b", "e", "value", "unc")])
        picks.append(F.min(F.when(F.col(f"_{p}").isNotNull(), found)).alias(f"_{p}"))
    return listed.join(_indexed(factor, params), match).groupBy(*keys.columns).agg(*picks)


def resolve_factors(
    df: DataFrame,
    factor: DataFrame,
    params: list[str],
    year: str = "year",
    land_use: str = "land_use",
    names: dict[str, str] | None = None,
    with_tier: bool = False,
) -> DataFrame:
    """Add the most specific factor in force for each parameter, null where there is none.

    Scopes are all combinations of country, zone and class, ranked as in
    ``SCOPES``; those with a column that ``df`` lacks are left out, and a null
    key only finds scopes without it. Any year is looked up. ``names`` renames
    the added columns; ``with_tier`` adds ``<name>_tier`` and ``<name>_unc``.

    Only the distinct keys of ``df`` are resolved, all parameters together, and
    the answer comes back in one join whose other side is unique by key.
    """
    names = names or {}
    on = {"country_id": "country_id", "zone": "zone", "land_use": land_use}
    have = [k for k in SCOPE if on[k] in df.columns]
    keys = df.select(*[F.col(on[k]).alias(f"_k_{k}") for k in have], F.col(year).alias("_k_year")).distinct()
    return _with_answer(df, _best(keys, factor, params, have), params, on, have, year, names, with_tier)


def resolve_both(df: DataFrame, factor: DataFrame, params: list[str], sides: dict[str, str]) -> DataFrame:
    """Factors for several class columns of a row: ``sides`` names each column's suffix.

    The keys of all sides are resolved at once; each side joins the same answer.
    """
    have = [k for k in SCOPE if k == "land_use" or k in df.columns]
    keys = df.select(
        *[F.col(k).alias(f"_k_{k}") for k in have if k != "land_use"],
        F.col("year").alias("_k_year"),
        F.explode(F.array(*sides)).alias("_k_land_use"),
    ).distinct()
    best = _best(keys, factor, params, have)
    for column, suffix in sides.items():
        on = {"country_id": "country_id", "zone": "zone", "land_use": column}
        names = {p: f"{p}_{suffix}" for p in params}
        df = _with_answer(df, best, params, on, have, "year", names, False)
    return df


def _with_answer(df, best, params, on, have, year, names, with_tier) -> DataFrame:
    match = F.col(year).eqNullSafe(F.col("_k_year"))
    for k in have:
        match &= F.col(on[k]).eqNullSafe(F.col(f"_k_{k}"))
    added = []
    for p in params:
        name = names.get(p, p)
        added.append(F.col(f"_{p}.value").alias(name))
        if with_tier:
            added += [F.col(f"_{p}.tier").alias(f"{name}_tier"), F.col(f"_{p}.unc").alias(f"{name}_unc")]
    return df.join(best, match, "left").select(*df.columns, *added)


def resolve_factor(df: DataFrame, factor: DataFrame, param: str, **options) -> DataFrame:
    """One parameter, with the tier that won and its relative uncertainty."""
    return resolve_factors(df, factor, [param], with_tier=True, **options)


def factor_in_force(df: DataFrame, factor: DataFrame, param: str, year: str = "year") -> DataFrame:
    """The factor whose validity holds the row's year, matched on class alone."""
    by_class = factor.filter("country_id is null and zone is null and land_use is not null")
    return resolve_factors(df, by_class, [param], year=year)


def missing_factors(df: DataFrame, factor: DataFrame, param: str, year: str = "year") -> DataFrame:
    """Keys of ``df`` without a factor at any tier, and how many rows they touch."""
    keys = [c for c in SCOPE if c in df.columns]
    seen = df.groupBy(*keys, year).agg(F.count("*").alias("n_rows"))
    return resolve_factors(seen, factor, [param], year=year).filter(F.col(param).isNull()).drop(param)


def latest_before(
    df: DataFrame,
    obs: DataFrame,
    key: str,
    at: str,
    obs_at: str,
    values: list[str],
    order: list[Column],
) -> DataFrame:
    """For each row the last observation of its key at or before its date.

    ``order`` breaks ties between observations of one day. Both sides are first
    cut to one row per key and day, so the window over a key grows with the days
    covered and not with the rows; the rows meet the answer in an equal-key join
    whose other side is unique.
    """
    days = df.select(key, F.col(at).alias("_at")).distinct()
    seen = latest_per_key(obs.select(key, obs_at, *values), [key, obs_at], order)
    payload = F.struct(F.col(obs_at).alias("_seen_at"), *[F.col(v) for v in values])
    stream = seen.select(key, F.col(obs_at).alias("_at"), F.lit(0).alias("_side"), payload.alias("_p"))
    stream = stream.unionByName(days.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    window = (
        Window.partitionBy(key)
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answer = (
        stream.withColumn("_last", F.last("_p", ignorenulls=True).over(window))
        .filter("_side = 1")
        .select(
            F.col(key).alias("_key"),
            "_at",
            F.col("_last._seen_at").alias(obs_at),
            *[F.col(f"_last.{v}").alias(v) for v in values],
        )
    )
    match = (F.col(key) == F.col("_key")) & (F.col(at) == F.col("_at"))
    return df.join(answer, match, "left").drop("_key", "_at")
