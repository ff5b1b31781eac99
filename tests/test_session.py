"""How much a task reads: the library's own bound, and smaller ones of the session."""

from __future__ import annotations

import pytest

from landflux.session import PARTITION_KEY, configure


@pytest.mark.parametrize(
    "given,left", [("64MB", "16m"), ("67108864b", "16m"), ("1g", "16m"), ("16m", "16m"), ("8m", "8m"), ("16k", "16k"), ("4096", "4096")]
)
def test_tasks_read_no_more_than_the_bound(spark, conf, given, left):
    conf({PARTITION_KEY: given})
    assert configure(spark).conf.get(PARTITION_KEY) == left
