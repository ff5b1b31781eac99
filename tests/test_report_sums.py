"""Reports sum the ledger by hash to their finest keys before anything is expanded or sorted."""

from __future__ import annotations

import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from test_plan_shapes import plan_of

from landflux.operators import report

ENTRY = "region_id int, process string, pool string, amount decimal(18,4), unit string"
DIMS = ["region_id", "process", "pool"]


@pytest.fixture
def rows():
    rng = random.Random(6)
    made = [(rng.choice([None, 1, 2]), rng.choice("ab"), rng.choice(["AGB", None]), Decimal(rng.randrange(-9999, 9999)) / 100, rng.choice(["tC", "tC", None])) for _ in range(400)]
    return [*made, (9, "c", "DW", None, "tC")]


def test_subtotals_with_nulls(spark, rows):
    entries = spark.createDataFrame(rows, ENTRY)
    found = report.report_cube(entries, DIMS)
    assert dict(found.dtypes)["amount"] == dict(report.totals(entries, DIMS).dtypes)["amount"] == "decimal(28,4)"
    want, known = Counter(), Counter()
    for *keys, amount, _ in rows:
        for level in range(8):
            key = (level, *[None if level >> (2 - n) & 1 else k for n, k in enumerate(keys)])
            want[key] += amount or 0
            known[key] += amount is not None
    got = {(r.level, r.region_id, r.process, r.pool): r.amount for r in found.collect()}
    assert got == {k: v if known[k] else None for k, v in want.items()}
    assert {(r.region_id, r.process, r.pool): r.amount for r in report.totals(entries, DIMS).collect()} == {
        k[1:]: v for k, v in got.items() if k[0] == 0
    }


@pytest.mark.parametrize("name", ["cube", "rollup", "sets", "totals", "key"])
def test_rows_are_summed_by_hash_first(spark, rows, name):
    entries = spark.createDataFrame(rows, ENTRY)
    build = {
        "cube": lambda: report.report_cube(entries, DIMS),
        "rollup": lambda: report.report_rollup(entries, DIMS),
        "sets": lambda: report.report_sets(entries, [["region_id"], []], DIMS),
        "totals": lambda: report.totals(entries, DIMS),
        "key": lambda: report._by_unit(entries, DIMS),
    }
    plan = plan_of(build[name]())
    steps = re.findall(r"(HashAggregate|SortAggregate|Sort|Expand)\b", plan[: plan.index("Scan")])
    assert steps[-2:] == ["HashAggregate", "HashAggregate"]


def test_a_group_of_two_units_stops(spark, rows):
    entries = spark.createDataFrame([*rows, (1, "a", "AGB", Decimal(1), "t gas")], ENTRY)
    for build in (lambda: report.report_cube(entries, DIMS), lambda: report.key_categories(entries, DIMS)):
        with pytest.raises(Exception, match="amounts in t gas and tC are not added"):
            build().collect()
