"""Curves fitted to the rows of groups, by sums alone.

A round of Levenberg and Marquardt's method needs only sums over a group's rows:
squared misfits, and products of the curve's derivatives. So rows never meet in
one task: a round joins every row to its group's parameters, adds up the sums in
each task and again by group, and refines the table of parameters, one row a
group. A group with a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landflux.session import keep

Curve = Callable[[dict[str, Column]], tuple[Column, dict[str, Column]]]

DAMP = 1e-3  # damping of the first step
MOST_DAMP = 1e12  # beyond, no step makes the misfit smaller


def saturating(x: str) -> Curve:
    """a * (1 - exp(-b * x)): fast at first, then towards the level a."""

    def curve(p: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
        left = F.exp(-p["b"] * F.col(x))
        return p["a"] * (1 - left), {"a": 1 - left, "b": p["a"] * F.col(x) * left}

    return curve


def _sums(data: DataFrame, keys: list[str], y: str, curve: Curve, names: list[str], trial: DataFrame) -> DataFrame:
    """Per group the number of rows, the squared misfit and the sums of products."""
    renamed = trial.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_trial")
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    value, slopes = curve({n: F.col("_trial")[i] for i, n in enumerate(names)})
    joined = data.join(renamed, match).select(
        *keys, (F.col(y) - value).alias("_r"), *[slopes[n].alias(f"_j{i}") for i, n in enumerate(names)]
    )
    used = joined.dropna(subset=["_r", *[f"_j{i}" for i in range(len(names))]])
    size = range(len(names))
    gradient = F.array(*[F.sum(F.col(f"_j{i}") * F.col("_r")) for i in size])
    normal = F.array(*[F.sum(F.col(f"_j{i}") * F.col(f"_j{j}")) for i in size for j in size])
    return used.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.count("*").alias("_n"), F.sum(F.col("_r") ** 2).alias("_misfit"), gradient.alias("_g"), normal.alias("_a")
    )


def _refine(state: pd.DataFrame, size: int, tolerance: float) -> pd.DataFrame:
    """The table of parameters after one round; groups that are done are left as they are."""
    trial, best = (np.array(state[c].tolist(), float).reshape(-1, size) for c in ("_trial", "_best"))
    fresh, old = (
        [np.array([v if v is not None else np.full(n, np.nan) for v in state[c]], float).reshape(-1, n) for c, n in names]
        for names in ((("_g", size), ("_a", size * size)), (("_best_g", size), ("_best_a", size * size)))
    )
    misfit, least = state["_misfit"].to_numpy(float), state["_least"].to_numpy(float)
    damp, done = state["_damp"].to_numpy(float).copy(), state["_done"].to_numpy(bool).copy()
    first = np.isnan(least)
    sound = np.isfinite(misfit) & np.isfinite(fresh[0]).all(axis=1) & np.isfinite(fresh[1]).all(axis=1)
    with np.errstate(invalid="ignore"):
        better = sound & (first | (misfit <= least)) & ~done
    moved = np.abs(trial - best) <= tolerance * (np.abs(best) + tolerance)
    settled = better & ~first & moved.all(axis=1)
    damp = np.where(better, np.maximum(damp / 10, 1e-12), damp * 10)
    best = np.where(better[:, None], trial, best)
    gradient, normal = (np.where(better[:, None], f, o) for f, o in zip(fresh, old, strict=True))
    least = np.where(better, misfit, least)
    # a group whose start gives no finite sums can't be refined
    failed = ~done & ~better & (first | (damp > MOST_DAMP))
    stops = done | settled | failed
    for i in np.flatnonzero(~stops):
        square = normal[i].reshape(size, size)
        step = np.linalg.pinv(square + damp[i] * np.diag(np.diag(square)), hermitian=True) @ gradient[i]
        trial[i] = best[i] + step
    state["_trial"], state["_best"] = list(trial), list(best)
    state["_best_g"], state["_best_a"] = list(gradient), list(normal)
    state["_least"], state["_damp"], state["_done"] = least, damp, stops
    state["_n"] = state["_n"].fillna(state["_count"]).astype("int64")
    state["_count"] = state["_n"]
    state["_sound"] = state["_sound"].to_numpy(bool) | better
    return state


def fit_rows(
    df: DataFrame, keys: list[str], y: str, curve: Curve, start: dict[str, Column], rounds: int = 50, tolerance: float = 1e-9
) -> DataFrame:
    """Per group the parameters of ``curve`` with the least squared misfit to ``y``.

    ``curve`` gives, from columns of its parameters, the curve and its derivative
    by each parameter; ``start`` names the parameters, each with an aggregate of
    the group to begin from. Rows for which ``y`` or the curve is null are left
    out. Returns keys, n, the parameters, rmse and converged: whether the last
    step moved every parameter by less than ``tolerance``, relatively, or no step
    helped any more; not so if ``rounds`` rounds were not enough. Parameters are
    null for a group without usable rows. Each round writes the table of parameters.
    """
    names, size = list(start), len(start)
    data = keep(df, "fit-rows")
    none = F.lit(None).cast("array<double>")
    begin = F.array(*[F.col(f"_p{i}").cast("double") for i in range(size)])
    state = data.groupBy(*keys).agg(*[column.alias(f"_p{i}") for i, column in enumerate(start.values())])
    state = state.select(
        *keys,
        begin.alias("_trial"),
        begin.alias("_best"),
        none.alias("_best_g"),
        none.alias("_best_a"),
        F.lit(None).cast("double").alias("_least"),
        F.lit(DAMP).alias("_damp"),
        F.exists(begin, lambda p: p.isNull()).alias("_done"),
        F.lit(0).cast("bigint").alias("_count"),
        F.lit(False).alias("_sound"),
    )
    state = keep(state, "fit-state")
    columns = state.columns

    def refine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield _refine(part, size, tolerance)[columns]

    for _ in range(rounds):
        open_ones = state.filter("not _done")
        if open_ones.isEmpty():
            break
        sums = _sums(data, keys, y, curve, names, open_ones)
        match = F.lit(True)
        for k in keys:
            match &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        met = open_ones.join(sums, match, "left").drop(*[f"_k_{k}" for k in keys])
        refined = met.mapInPandas(refine, state.schema)
        state = keep(refined.unionByName(state.filter("_done")), "fit-state")
    found = [F.when(F.col("_sound"), F.col("_best")[i]).alias(n) for i, n in enumerate(names)]
    rmse = F.when(F.col("_sound"), F.sqrt(F.col("_least") / F.col("_count")))
    return state.select(
        *keys, F.col("_count").alias("n"), *found, rmse.alias("rmse"), (F.col("_done") & F.col("_sound")).alias("converged")
    )
