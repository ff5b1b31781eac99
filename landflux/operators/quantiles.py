"""Exact quantiles without a large group in one task.

Everything starts from counts: how often each value occurs in each group, with
values as whole multiples of ``1 / scale``. Copies of a value are merged before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
LEVELS = (2 * BITS, BITS, 0)  # 60 bits of value, and the sign


def value_counts(df: DataFrame, by: list[str], value: str, scale: int) -> DataFrame:
    """Columns ``by``, ``v`` and ``n``: how often each value occurs; nulls are left out."""
    return (
        df.filter(f"{value} is not null")
        .selectExpr(*by, f"cast(round({value} * {scale}) as bigint) as v")
        .groupBy(*by, "v")
        .agg(F.count("*").alias("n"))
    )


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], scale: int = 10_000
) -> DataFrame:
    """Interpolated quantiles of ``value`` per group, and the group's size ``n``.

    ``scale`` is the finest step of the value. The values at the wanted ranks
    are found 20 bits at a time: each level counts rows by a longer prefix of
    the value, inside the prefix chosen before. A window sees at most 2^20
    prefixes, however large the group. ``df`` is read once per level: hand over
    a stored table (``session.keep``) where much work stands behind it.
    """
    keys = ", ".join(by)
    ends = ", ".join(
        f"cast({f}((n - 1) * {p}D) as bigint)" for p in probs.values() for f in ("floor", "ceil")
    )
    counts = value_counts(df, by, value, scale)
    current = None
    for shift in LEVELS:
        level = (
            counts.selectExpr(*by, f"shiftright(v, {shift}) as _p", "n as _n")
            .groupBy(*by, "_p")
            .agg(F.sum("_n").alias("_n"))
        )
        if current is None:
            joined = level.selectExpr(
                *by,
                "_p",
                "_n",
                f"sum(_n) over (partition by {keys}) as n",
                f"sum(_n) over (partition by {keys} order by _p) as _upto",
            ).selectExpr("*", f"explode(array_distinct(array({ends}))) as rank")
        else:
            # joined on the prefix too, so that a large group is spread by it
            level = level.withColumn("_prefix", F.expr(f"shiftright(_p, {BITS})"))
            upto = f"_base + sum(_n) over (partition by {keys}, rank order by _p)"
            # null-safe, as a group may have a null key
            other = level.withColumnsRenamed({c: f"_l_{c}" for c in [*by, "_prefix"]})
            match = F.lit(True)
            for c in [*by, "_prefix"]:
                match &= F.col(c).eqNullSafe(F.col(f"_l_{c}"))
            joined = current.join(other, match).drop("_prefix", *[f"_l_{c}" for c in [*by, "_prefix"]])
            joined = joined.withColumn("_upto", F.expr(upto))
        current = joined.filter("_upto > rank and _upto - _n <= rank").selectExpr(
            *by, "n", "rank", "_upto - _n as _base", "_p as _prefix"
        )
    picked = current.groupBy(*by, "n").agg(
        F.expr("map_from_entries(collect_list(struct(rank, _prefix))) as _at")
    )
    out = []
    for name, p in probs.items():
        at = f"((n - 1) * {p}D)"
        low = f"cast(_at[cast(floor({at}) as bigint)] as double)"
        high = f"cast(_at[cast(ceil({at}) as bigint)] as double)"
        out.append(f"({low} + ({high} - {low}) * ({at} - floor({at}))) / {scale}D as {name}")
    return picked.selectExpr(*by, "n", *out)


def with_median(counts: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Add the median of ``value``, weighted by ``n``, to every row of its group.

    For groups with few distinct values: a group's counts, though not its rows,
    pass through one sorted (and spillable) window.
    """
    keys = ", ".join(by)
    at_least = "min(case when _upto > {end} then {value} end) over (partition by {keys})"
    low = at_least.format(end="floor((_total - 1) / 2)", value=value, keys=keys)
    high = at_least.format(end="ceil((_total - 1) / 2)", value=value, keys=keys)
    return (
        counts.selectExpr(
            "*",
            f"sum(n) over (partition by {keys}) as _total",
            f"sum(n) over (partition by {keys} order by {value}) as _upto",
        )
        .withColumn(out, F.expr(f"({low} + {high}) / 2"))
        .drop("_total", "_upto")
    )
