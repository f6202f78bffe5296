from tidemark.plans import (
    arrival_plans, audit_plans, commit_plans, compare_plans, feed_plans, ingest_plans, maintenance_plans,
    offset_plans, restart_plans, sample_plans, session_plans, state_plans, txn_plans,
)
from tidemark.plans.registry import merged

ALL = merged(*[
    plans.REGISTRY for plans in (
        feed_plans, audit_plans, ingest_plans, offset_plans, commit_plans, restart_plans,
        sample_plans, maintenance_plans, txn_plans, compare_plans, arrival_plans,
        state_plans, session_plans,
    )
])
