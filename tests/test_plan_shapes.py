"""What the physical plans must and must not hold."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from conftest import ROOT, SF

from landflux.operators import land
from landflux.plans import REGISTRY, inputs
from landflux.sources import LandTables

SMALL = SF.format("0.001")
# these run jobs or streams while they are built
EAGER = {"ledger_store", "coverage_of_spans", "distribution_of_spans", "full_report", "saturating_growth", "streamed_budget_days", "factors_from_file", "streamed_half_hours", "streamed_budget", "late_readings"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().treeString()


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in EAGER])
def test_no_pairwise_joins(spark, name):
    plan = plan_of(REGISTRY[name].run(spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["ledger", "report_rollup", "double_count", "bookkeeping"])
def test_no_python_workers(spark, name):
    plan = plan_of(REGISTRY[name].run(spark, SMALL))
    assert "Python" not in plan and "Pandas" not in plan


def test_dates_and_columns_reach_the_scan(spark):
    tables = LandTables(spark, SMALL, since="1997-01-01", until="1998-01-01")
    df = land.dominant_land_use(tables.land_obs)
    plan = plan_of(df)
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "l_shipdate" in line)
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan
    schema = re.search(r"ReadSchema: struct<(.*?)>", scan).group(1)
    assert "l_discount" not in schema and "l_suppkey" not in schema
    assert {r.year for r in df.collect()} == {1997}


def test_dominant_class_shuffles_once(spark):
    tables = LandTables(spark, SMALL)
    obs = tables.land_obs.select("unit_id", "obs_date", "land_use", "area_ha")
    exchanges = plan_of(land.dominant_land_use(obs)).count("Exchange hashpartitioning(unit_id")
    assert exchanges == 1


def test_full_ledger_reads_its_parents_stored(spark):
    """Observations are read for the states alone, events once a part that books them; changes are found once."""
    plan = plan_of(inputs.full_ledger(LandTables(spark, SMALL)))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert not any("p_type" in line for line in scans)
    # fires and nitrogen, for their keys and for their rows
    assert sum("l_shipdate" in line for line in scans) <= 4
    assert "lead(" not in plan


def test_top_one_is_cut_before_the_shuffle(spark):
    plan = plan_of(REGISTRY["latest_survey_per_day"].run(spark, SMALL))
    partial = plan.index("Partial")
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < partial


def test_sources_force_nothing():
    """No broadcast hints, no local checkpoints, no driver collects in the library."""
    for path in Path(ROOT / "landflux").rglob("*.py"):
        if "llm" in path.parts:  # its bounded collects are stated there
            continue
        text = path.read_text()
        for banned in ("broadcast(", "localCheckpoint", "crossJoin", ".collect()", "toPandas"):
            assert banned not in text, (path, banned)
