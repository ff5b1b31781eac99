"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder (default /root/testdata/sf0.1) and
``BENCH_CPUS`` the cores. Every query is built and run to its last row; the
second of two runs counts, so that start-up and code generation of a fresh
session are left out.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from landflux.plans import REGISTRY
from landflux.session import local_session

HEADLINE = [
    "conversion_by_region",
    "dominant_land_use",
    "transition_matrix",
    "land_use_spells",
    "provider_agreement",
    "latest_survey_before_event",
    "biomass_gain",
    "disturbance_loss",
    "soil_mineral",
    "stock_difference",
    "hwp_pool",
    "bookkeeping",
    "report_rollup",
    "top_emitters",
    "distribution",
    "monte_carlo",
    "all_carbon_check",
    "double_count",
    "half_hour_means",
    "sliding_day",
    "tower_sessions",
    "despike",
    "gap_fill",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    times = {}
    with tempfile.TemporaryDirectory(prefix="landflux-bench-") as shared:
        spark = local_session("bench", cores, **{"spark.driver.memory": "8g", "spark.checkpoint.dir": shared})
        for name in HEADLINE:
            run(spark, name, folder)
            times[name] = round(run(spark, name, folder), 3)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
