"""Every registered query against its SQL, and the plans Spark makes for it."""

from __future__ import annotations

import pytest
from compare import connect, differences
from conftest import SF

from landflux.plans import REGISTRY

SMALL = SF.format("0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, duck, name):
    problem, n, _, _ = differences(spark, duck, REGISTRY[name], SMALL)
    assert problem is None
    # every unit of this small folder is seen in its first year
    assert n > 0 or name == "units_without_class"


def test_entry_point_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows_only = set(entry.queries()) - set(entry.oracle_sql())
    assert {n for n in rows_only if n in REGISTRY} == set()


def test_golden_slice(spark):
    """Region 0 at sf0.01, fixed before anything was built."""
    rows = REGISTRY["conversion_by_region"].run(spark, SF.format("0.01")).collect()
    assert len(rows) == 30
    found = {(r.region_id, r.year): (r.change, r.n_pairs) for r in rows}
    assert found[0, 1996] == (56589.0, 275)
    assert found[0, 1997] == (-580.0, 279)
    assert found[0, 1998] == (25008.0, 278)
