"""The public surface in one place: DataFrames in, DataFrames out."""

from context_shaper.functions.display import format_tokens, format_usd
from context_shaper.functions.models import (
    context_window,
    input_cost_usd,
    pricing,
    provider,
    ttft_seconds,
)
from context_shaper.functions.text import content_hash, estimate_tokens, preview
from context_shaper.operators.alerts import AlertOptions, alert_text, deep_checks, migrate_owned_state, owned_checks
from context_shaper.operators.findings import Thresholds, all_findings, ordered_findings
from context_shaper.operators.impact import (
    fleet_cube,
    fleet_rollup,
    fleet_totals,
    grand_total,
    hook_activity,
    savings_by_family,
    session_activity,
    session_report,
)
from context_shaper.operators.lookup import pattern_values, price_table, window_table, with_pattern_values
from context_shaper.operators.measure import measure
from context_shaper.operators.normalize import conversations, from_turns, normalize, plain_messages
from context_shaper.operators.rewrite import RewriteOptions
from context_shaper.operators.totals import category_shares, conversation_totals, largest_messages
from context_shaper.operators.writeback import replace_contents, rewrite_documents
from context_shaper.plans.optimize import optimize
from context_shaper.plans.profile import build_profile, headline, profile
from context_shaper.plans.requests import (
    forwarded_bodies,
    optimize_requests,
    request_results,
    request_totals,
)
from context_shaper.plans.sessions import ProfileTable, check_sessions, profile_sessions, report_from_files
from context_shaper.session import local_session, stage
from context_shaper.sources.documents import read_documents, rejected_documents
from context_shaper.sources.ledger import append_ledger, compact_ledger, read_ledger, retained
from context_shaper.sources.ledger_store import LedgerStore
from context_shaper.sources.requests import prompt_events, prompt_measurements, route
from context_shaper.sources.sinks import as_json, write_json, write_table
from context_shaper.sources.transcripts import (
    recent_sessions,
    session_inventory,
    sessions,
    transcript_entries,
    transcript_messages,
)
from context_shaper.streaming.alerts import deep_check_stream, ledger_sink, owned_check_stream
from context_shaper.streaming.impact import activity_as_of, hook_activity_as_of, impact_streams, savings_as_of
from context_shaper.streaming.requests import (
    optimize_request_stream,
    request_result_stream,
    running_totals,
    running_totals_stream,
)
from context_shaper.streaming.savings import late_entries, savings_by_window, window_totals, windowed_savings_stream
from context_shaper.streaming.watch import (
    watch_long_histories,
    watch_repeats,
    watch_row_findings,
    watch_status,
)

__all__ = [
    "AlertOptions", "LedgerStore", "ProfileTable", "RewriteOptions", "Thresholds", "activity_as_of",
    "alert_text", "all_findings", "append_ledger", "as_json", "build_profile", "category_shares",
    "check_sessions", "compact_ledger", "content_hash", "context_window", "conversation_totals",
    "conversations", "deep_check_stream", "deep_checks", "estimate_tokens", "fleet_cube",
    "fleet_rollup", "fleet_totals", "format_tokens", "format_usd", "forwarded_bodies", "from_turns",
    "grand_total", "headline", "hook_activity", "hook_activity_as_of", "impact_streams",
    "input_cost_usd", "largest_messages", "late_entries", "ledger_sink", "local_session", "measure",
    "migrate_owned_state", "normalize", "optimize", "optimize_request_stream", "optimize_requests",
    "ordered_findings", "owned_check_stream", "owned_checks", "pattern_values", "plain_messages",
    "preview", "price_table", "pricing", "profile", "profile_sessions", "prompt_events",
    "prompt_measurements", "provider", "read_documents", "read_ledger", "recent_sessions",
    "rejected_documents", "replace_contents", "report_from_files", "request_result_stream",
    "request_results", "request_totals", "retained", "rewrite_documents", "route", "running_totals",
    "running_totals_stream", "savings_as_of", "savings_by_family", "savings_by_window",
    "session_activity", "session_inventory", "session_report", "sessions", "stage",
    "transcript_entries", "transcript_messages", "ttft_seconds", "watch_long_histories",
    "watch_repeats", "watch_row_findings", "watch_status", "window_table", "window_totals",
    "windowed_savings_stream", "with_pattern_values", "write_json", "write_table",
]
