"""Registered queries, each with the SQL that checks it."""

from landflux.plans import flux_plans, land_plans, report_plans, source_plans, span_plans, tower_plans  # noqa: F401
from landflux.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
