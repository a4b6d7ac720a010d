"""Sensitive-text and language-model traffic analytics on Spark."""

from .functions.rules import Rule, Rules
from .operators.access import authenticate, authenticate_as_of, rate_limit, requests_by_user
from .operators.attempts import attempt_outcome, backoff_ms, fallback_usage, is_retryable
from .operators.audit import (
    activity,
    audit_events,
    audit_rollup,
    dashboard,
    live_totals,
    recent_activity,
)
from .operators.detect import findings, pii_counts, pii_types, scan
from .operators.gateway import gateway_decisions
from .operators.policy import (
    Policy,
    classify,
    evaluate_policy,
    policy_action,
    policy_summary,
    quarantine_split,
)
from .operators.registry import (
    active_tokens,
    apply_registry_changes,
    flatten_registry,
    registry_from_keys,
    token_preview,
    user_by_id,
    users,
)
from .operators.reuse import cache_stats, content_key, content_repeats, reuse_responses, ttl_cache_hits
from .operators.spend import (
    budget_gate,
    budget_status,
    parse_usage,
    spend_by_user,
    spend_totals,
    user_group,
    with_cost,
)
from .operators.tokens import (
    assign_tokens,
    redact,
    redact_table,
    restore,
    restore_table,
    token_map,
    token_stats,
)
from .settings import DEFAULTS, Settings, build_session, clean_scratch, scratch
from .sources.catalog import providers, search_providers, with_provider
from .sources.tables import (
    read_attempts,
    read_audit,
    read_registry,
    read_registry_changes,
    read_requests,
    read_responses,
    spread,
    stream_audit,
    stream_requests,
    write_audit,
    write_registry,
)

__all__ = [name for name in dir() if not name.startswith("_")]
