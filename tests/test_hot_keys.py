"""One key with a third of all rows: same answers as brute force, and work spread out."""

from __future__ import annotations

import bisect
import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landflux.operators import checks, factors, land
from landflux.operators.quantiles import exact_quantiles
from landflux.sources import LandTables
from landflux.streaming import towers

N = 3000
DAY0 = dt.date(2000, 1, 1)


def hot(rng: random.Random, others: int = 200) -> int:
    return 0 if rng.random() < 1 / 3 else rng.randrange(1, others)


def test_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    data = [(hot(rng, 40), round(rng.choice([0.0, -3.5, rng.gauss(0, 1e6), rng.gauss(0, 2)]), 4)) for _ in range(N)]
    data += [(77, 5.25), (78, -1.0), (78, 1.0), (79, None)]
    df = spark.createDataFrame(data, "g int, v double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    frame = pd.DataFrame(data, columns=["g", "v"]).dropna()
    assert set(got) == set(frame.g)
    for g, part in frame.groupby("g"):
        assert got[g].n == len(part)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part.v, p), rel=1e-9, abs=1e-9)


def test_quantiles_of_one_large_group(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 1.0 - 50_000).alias("v"))
    (row,) = exact_quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.999}).collect()
    assert row.m == 49_999.5 and row.q == pytest.approx(0.999 * 199_999 - 50_000)


def test_double_count_equals_pairs(spark):
    rng = random.Random(2)
    claims = []
    for i in range(N):
        start = DAY0 + dt.timedelta(days=rng.randrange(900))
        claims.append((str(i), hot(rng, 300), "fire", start, start + dt.timedelta(days=rng.randrange(40))))
    df = spark.createDataFrame(
        claims, "claim_id string, unit_id bigint, kind string, start_date date, end_date date"
    )
    got = {r.claim_id: r.n_overlaps for r in checks.double_count(df).collect()}
    want = Counter()
    by_unit: dict[int, list] = {}
    for c in claims:
        by_unit.setdefault(c[1], []).append(c)
    for group in by_unit.values():
        for a in group:
            n = sum(a[3] <= b[4] and b[3] <= a[4] for b in group) - 1
            if n:
                want[a[0]] = n
    assert got == dict(want)


def test_provider_pairs_are_counted_not_made(spark):
    rng = random.Random(3)
    uses = ["forest", "other", "wetland"]
    obs = [
        (hot(rng, 50), dt.date(2000, 1 + rng.randrange(12), 1), rng.choice(uses), Decimal(1 + rng.randrange(5)), rng.randrange(400))
        for _ in range(N)
    ]
    df = spark.createDataFrame(
        obs, "unit_id bigint, obs_date date, land_use string, area_ha decimal(18,4), provider_id bigint"
    )
    sums: dict[tuple, Counter] = {}
    for unit, _, use, area, provider in obs:
        sums.setdefault((unit, provider), Counter())[use] += area
    named: dict[int, list] = {}
    for (unit, provider), areas in sums.items():
        named.setdefault(unit, []).append((provider, min(areas, key=lambda u: (-areas[u], u))))
    pairs, agreed, compared = Counter(), Counter(), Counter()
    for group in named.values():
        for i, (p, a) in enumerate(group):
            for q, b in group[i + 1 :]:
                pairs[min(a, b), max(a, b)] += 1
                for one in (p, q):
                    compared[one] += 1
                    agreed[one] += a == b
    got = {(r.use_a, r.use_b): r.pairs for r in land.provider_confusion(df).collect()}
    assert got == dict(pairs)
    scores = {r.provider_id: (r.compared, r.agreed) for r in land.provider_agreement(df).collect() if r.compared}
    assert scores == {p: (compared[p], agreed[p]) for p in compared}


def test_readings_after_alert_equal_pairs(spark):
    rng = random.Random(4)
    base = dt.datetime(2024, 1, 1)

    def moment():
        return base + dt.timedelta(seconds=rng.randrange(40 * 86400))

    readings = [(i, hot(rng, 30), moment()) for i in range(N)]
    alerts = [(hot(rng, 30), moment()) for _ in range(150)]
    # exactly on the edges of the interval
    readings += [(N, 5, alerts[0][1]), (N + 1, alerts[0][0], alerts[0][1] + dt.timedelta(hours=6))]
    df = spark.createDataFrame(readings, "reading_id bigint, tower_id bigint, ts timestamp")
    al = spark.createDataFrame(alerts, "tower_id bigint, alert_ts timestamp")
    got = [r.reading_id for r in towers.readings_after_alert(df, al, 6).collect()]
    span = dt.timedelta(hours=6)
    want = {i for i, t, ts in readings if any(a == t and s <= ts <= s + span for a, s in alerts)}
    assert len(got) == len(set(got)) and set(got) == want and N + 1 in want


def test_latest_before_equals_bisect(spark):
    rng = random.Random(5)
    surveys: dict[int, list] = {}
    for i in range(N):
        surveys.setdefault(hot(rng), []).append((DAY0 + dt.timedelta(days=rng.randrange(500)), i))
    events = [(hot(rng), DAY0 + dt.timedelta(days=rng.randrange(500)), i) for i in range(N)]
    out = factors.latest_before(
        spark.createDataFrame(events, "unit_id bigint, event_date date, id int"),
        spark.createDataFrame(
            [(u, d, i) for u, group in surveys.items() for d, i in group],
            "unit_id bigint, survey_date date, plot_obs_id int",
        ),
        "unit_id",
        "event_date",
        "survey_date",
        ["plot_obs_id"],
        [F.desc("plot_obs_id")],
    )
    got = {r.id: r.plot_obs_id for r in out.collect()}
    assert len(got) == N
    for unit, day, i in events:
        group = sorted(surveys.get(unit, []))
        at = bisect.bisect_right(group, (day, 10**9))
        assert got[i] == (group[at - 1][1] if at else None)


def test_hot_tower_day_is_despiked(spark):
    rng = random.Random(6)
    data = [
        (i, hot(rng, 20), dt.datetime(2024, 1, 1 + rng.randrange(2), rng.randrange(24)), "view", round(rng.gauss(0, 5), 2), 1.0)
        for i in range(N)
    ]
    schema = "reading_id bigint, tower_id bigint, ts timestamp, kind string, flux double, temp_c double"
    frame = pd.DataFrame(data, columns=["reading_id", "tower_id", "ts", "kind", "flux", "temp_c"])
    frame["day"] = frame.ts.dt.date
    groups = frame.groupby(["tower_id", "day"]).flux
    off = (frame.flux - groups.transform("median")).abs()
    mad = off.groupby([frame.tower_id, frame.day]).transform("median")
    want = set(frame.reading_id[off <= 3 * mad + 1e-9])
    kept = towers.despike(spark.createDataFrame(data, schema), 3.0)
    assert {r.reading_id for r in kept.collect()} == want


def test_hot_order_is_split_by_adaptive_execution(spark, conf, tmp_path):
    """The join of observations with their order: a third of them share one order."""
    conf(
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        }
    )
    n = 240_000
    ids = spark.range(n)
    order = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id") % 5000)
    ids.repartition(8).select(
        F.pmod(order, F.lit(5000)).alias("l_orderkey"),
        (F.col("id") % 50).alias("l_partkey"),
        (F.col("id") % 30).alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"),
        (F.col("id") % 50).cast("double").alias("l_quantity"),
        F.lit(0.05).alias("l_discount"),
        F.lit("N").alias("l_returnflag"),
        F.lit("1999-05-05 00:00:00").cast("timestamp_ntz").alias("l_shipdate"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(5000).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 300).alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"),
        F.lit("1999-05-05 00:00:00").cast("timestamp_ntz").alias("o_orderdate"),
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(50).select(F.col("id").alias("p_partkey"), F.lit("LARGE").alias("p_type")).write.parquet(
        str(tmp_path / "part.parquet")
    )
    obs = LandTables(spark, str(tmp_path)).land_obs
    state = land.dominant_land_use(obs)
    total = state.agg(F.sum("area_ha").alias("a"))
    rows = total.collect()
    plan = total._jdf.queryExecution().executedPlan().treeString()
    assert "skew=true" in plan
    assert rows[0].a == sum(i % 50 for i in range(n))
