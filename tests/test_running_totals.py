"""Running sums over very many keys."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from landflux.operators import report, scans
from landflux.sources.schemas import MONEY


def ledger_of(spark, n, amount):
    return spark.range(n).select(
        F.col("id").alias("unit_id"), (F.col("id") % 7).alias("country_id"), amount.cast(MONEY).alias("amount"), F.lit("tC").alias("unit")
    )


def test_a_million_categories_in_many_tasks(spark, conf):
    conf({"spark.sql.adaptive.coalescePartitions.enabled": "false"})
    n = 1_000_000
    entries = ledger_of(spark, n, (F.col("id") * 7919 % 100_003 - 50_000) / 100)
    got = report.key_categories(entries, ["unit_id"], 0.9).toPandas().sort_values("cumulative_share")
    ids = np.arange(n)
    cents = ids * 7919 % 100_003 - 50_000
    order = np.lexsort((ids, -np.abs(cents)))
    upto = np.cumsum(np.abs(cents)[order])
    wanted = int(np.searchsorted((upto - np.abs(cents)[order]) / upto[-1], 0.9 - 1e-9))
    assert len(got) == wanted and set(got.unit_id) == set(order[:wanted].tolist())
    assert np.allclose(got.cumulative_share.to_numpy(), upto[:wanted] / upto[-1], atol=1e-12)


def test_ranges_hold_their_share(spark, conf):
    """Half of all rows have the same size: the other keys order them, and spread them."""
    conf({"spark.sql.adaptive.coalescePartitions.enabled": "false"})
    df = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("size"))
    placed = scans.ranged(df, [F.col("size").desc(), F.col("id")], "test")
    counts = [r["count"] for r in placed.groupBy(F.shiftright("_pos", 33)).count().collect()]
    assert len(counts) == 8 and max(counts) < 10_000
    rows = scans.running_total(placed, "size", "upto").orderBy("_pos").collect()
    sizes = sorted(((5 if i % 2 == 0 else i, -i) for i in range(40_000)), reverse=True)
    assert [(r["size"], r.id) for r in rows] == [(s, -i) for s, i in sizes]
    assert [r.upto for r in rows] == np.cumsum([s for s, _ in sizes]).tolist()


def test_shares_of_many_groups(spark):
    entries = ledger_of(spark, 5000, F.col("id") % 13 - 4).withColumn("country_id", F.when(F.col("country_id") > 0, F.col("country_id")))
    got = {(r.country_id, r.unit_id): r for r in report.share_of_total(entries, "unit_id", "country_id").collect()}
    amounts = {i: i % 13 - 4 for i in range(5000)}
    whole = sum(amounts.values())
    for (country, unit), r in got.items():
        part = sum(a for i, a in amounts.items() if (i % 7 or None) == country)
        assert r.share_world == pytest.approx(amounts[unit] / whole) and r.share_within == pytest.approx(amounts[unit] / part)
    assert len(got) == 5000


def test_nothing_to_add(spark):
    none = ledger_of(spark, 0, F.lit(1))
    assert report.key_categories(none, ["unit_id"]).count() == 0 and report.share_of_total(none, "unit_id", "country_id").count() == 0
    zeros = report.share_of_total(ledger_of(spark, 3, F.lit(0)), "unit_id", "country_id").collect()
    assert [r.share_world for r in zeros] == [None] * 3
