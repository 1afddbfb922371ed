"""All queries of the engine by name."""

from __future__ import annotations

from . import dense_plans, lexical_plans, navigation_plans, navigator_plans, policy_plans, record_plans, supervision_plans, trace_plans, training_plans
from .query import Query

QUERIES: dict[str, Query] = {**lexical_plans.QUERIES, **dense_plans.QUERIES, **training_plans.QUERIES, **navigation_plans.QUERIES, **navigator_plans.QUERIES, **supervision_plans.QUERIES, **policy_plans.QUERIES, **record_plans.QUERIES, **trace_plans.QUERIES}
