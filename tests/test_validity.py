"""Factors with many validities, against a plain search of every row."""

from __future__ import annotations

import random

from plan_rows import rows_made

from landflux.operators import factors
from landflux.sources.literals import small_table
from landflux.sources.schemas import FACTOR

KEY = "id int, country_id int, zone string, land_use string, year int"


def plain(rows, key, param):
    """Value and tier of the best row: tier, then the latest start, then end and value."""
    _, *own, year = key
    best = None
    for p, country, zone, use, low, high, value, _, unc in rows:
        scope = [country, zone, use]
        if p != param or any(s is not None and s != k for s, k in zip(scope, own, strict=True)):
            continue
        if year is not None and not (low is None or low <= year) or year is not None and not (high is None or year <= high):
            continue
        tier = factors.TIER_OF[tuple(n for n, s in zip(factors.SCOPE, scope, strict=True) if s is not None)]
        choice = (tier, 1 << 40 if low is None else -low, 1 << 40 if high is None else high, value, unc)
        best = choice if best is None else min(best, choice)
    return (best[3], best[0]) if best else (None, None)


def test_any_validity_and_any_year(spark):
    rng = random.Random(11)
    ends = [None, -9999, 0, 1499, 1500, 1501, 1990, 2000, 2003, 2004, 2007, 2522, 2523, 2524, 4000, 9999]
    rows = []
    for n in range(600):
        low, high = rng.choice([*ends, rng.randint(1480, 2540)]), rng.choice([*ends, rng.randint(1480, 2540)])
        scope = rng.choice([None, 1, 2]), rng.choice([None, "a"]), rng.choice([None, "forest", "other"])
        rows.append((rng.choice("pq"), *scope, low, high, float(n % 97), "", 0.1))
    years = [None, -20000, -9999, -1, 1499, 1500, 2523, 2524, 3999, 4001, 9999, 10000, 70000, *range(1996, 2010)]
    keys = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice(["forest", "other", "wetland", None]), y) for i, y in enumerate(years * 12)]
    table = small_table(spark, rows, FACTOR)
    for kept in (rows, [r for r in rows if r[1] and r[2]]):
        table = small_table(spark, kept, FACTOR)
        found = factors.resolve_factors(spark.createDataFrame(keys, KEY), table, ["p", "q"], with_tier=True)
        got = {r.id: r for r in found.collect()}
        assert len(got) == len(keys)
        for key in keys:
            assert (got[key[0]].p, got[key[0]].p_tier) == plain(kept, key, "p"), key
            assert (got[key[0]].q, got[key[0]].q_tier) == plain(kept, key, "q"), key


def test_cells_make_up_their_range_once(spark):
    rng = random.Random(5)
    ranges = [(1500, 2523), (1500, 1500), (2523, 2523), (1999, 1998), *{tuple(sorted(rng.choices(range(1500, 2524), k=2))) for _ in range(60)}]
    df = spark.createDataFrame(ranges, "low int, high int")
    cells = {}
    for r in factors._with_cells_of_range(df, "low", "high").collect():
        cells.setdefault((r.low, r.high), []).append(r._cell)
    year = spark.range(1500, 2524).selectExpr("cast(id as int) as year")
    under = {r.year: set(r.cells) for r in year.select("year", factors._cells_of_year(year.year).alias("cells")).collect()}
    for low, high in ranges:
        inside = [c for c in cells[low, high] if c >= 0]
        assert len(inside) <= 6 * factors.LEVELS
        for y in under:
            assert len(under[y] & set(inside)) == (1 if low <= y <= high else 0)


def test_many_validities_of_one_scope_meet_a_key_in_few_rows(spark):
    """20,000 yearly and open validities of the world: a key meets a few, not all that hold its year."""
    rows = [("p", None, None, None, 1600 + i % 400, None if i % 2 else 2100 + i % 300, float(i), "", 0.1) for i in range(20_000)]
    table = small_table(spark, rows, FACTOR)
    keys = spark.createDataFrame([(i, i % 7, "a", "forest", 1900 + i % 100) for i in range(700)], KEY)
    found = factors.resolve_factors(keys, table, ["p"])
    assert rows_made(found, "BroadcastHashJoin") + rows_made(found, "SortMergeJoin") <= 700 * factors.LEVELS * 2 + 700
    r = {r.id: r.p for r in found.collect()}
    assert r[0] == plain(rows, (0, 0, "a", "forest", 1900), "p")[0]
