"""Values that results depend on, kept together and in plain text.

Everything in this module is a fixed value: changing one changes token counts, costs,
findings or rewritten text.  Thresholds are the defaults of keyword arguments elsewhere.
"""

# --- fixed values: token estimate -------------------------------------------------------
# Characters that mark code-like text, and the two characters-per-token rates.
SYMBOL_CHARACTERS = r"""{}[]()<>;:=_/\|"'`#$%&*+^~-"""
DENSE_SYMBOL_SHARE = 0.08
CHARS_PER_TOKEN_DENSE = 3.2
CHARS_PER_TOKEN_PROSE = 4.0
MESSAGE_OVERHEAD_TOKENS = 4

# --- fixed values: whitespace as JavaScript's \s sees it --------------------------------
ASCII_WHITESPACE = " \t\n\x0b\f\r"
UNICODE_WHITESPACE_CLASS = r"\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# UTF-8 byte prefixes that every one of those non-ASCII characters starts with.
UNICODE_WHITESPACE_BYTES = ("C2A0", "E19A80", "E280", "E2819F", "E38080", "EFBBBF")

# --- fixed values: inline binary data ---------------------------------------------------
DATA_URI_PATTERN = r"data:[\w/+.-]+;base64,"
DATA_URI_HINT = ";base64,"
BLOB_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BLOB_RUN_CHARS = 500

# --- fixed values: roles, kinds, categories ---------------------------------------------
PLAIN_ROLES = ("system", "user", "assistant")
KIND_TO_CATEGORY = {
    "system": "system",
    "user": "user",
    "assistant": "assistant",
    "tool_call": "tool_calls",
    "tool_result": "tool_results",
}
CATEGORIES = ("system", "user", "assistant", "tool_calls", "tool_results", "other")
CATEGORY_LABELS = {
    "system": "System prompt",
    "user": "User messages",
    "assistant": "Assistant replies",
    "tool_calls": "Tool calls",
    "tool_results": "Tool results",
    "other": "Other",
}

# --- fixed values: model context windows, first matching pattern wins -------------------
MODEL_WINDOWS = (
    (r"claude.*haiku", 200_000),
    (r"claude.*(fable|mythos)|claude.*opus-?(5|4-[678])|claude.*sonnet-?(5|4-6)", 1_000_000),
    (r"claude.*sonnet|claude.*opus|claude-\d", 200_000),
    (r"gpt-5", 400_000),
    (r"gpt-4o|gpt-4-turbo|gpt-4\.1|o[134](-|$)", 128_000),
    (r"gpt-4(?!o|\.|-turbo)", 8_192),
    (r"gpt-3\.5", 16_385),
    (r"gemini.*(1\.5|2\.|2-5)", 1_000_000),
    (r"llama.*3", 128_000),
    (r"mistral|mixtral", 32_000),
)

# --- fixed values: USD per million tokens (input, output, cached read), first match wins --
MODEL_PRICES = (
    (r"claude.*fable|claude.*mythos", (10.0, 50.0, 1.0)),
    (r"claude.*opus", (5.0, 25.0, 0.5)),
    (r"claude.*sonnet", (3.0, 15.0, 0.3)),
    (r"claude.*haiku", (1.0, 5.0, 0.1)),
    (r"gpt-5.*(mini|nano)", (0.25, 2.0, 0.025)),
    (r"gpt-5", (1.25, 10.0, 0.125)),
    (r"gpt-4o-mini", (0.15, 0.6, 0.075)),
    (r"gpt-4o|gpt-4\.1", (2.5, 10.0, 1.25)),
    (r"gpt-4-turbo", (10.0, 30.0, 10.0)),
    (r"o[13](-|$)", (2.0, 8.0, 1.0)),
    (r"gemini.*flash", (0.1, 0.4, 0.025)),
    (r"gemini.*pro", (1.25, 5.0, 0.31)),
)

# --- fixed values: providers and model families -----------------------------------------
PROVIDERS = ((r"claude", "anthropic"), (r"gpt|^o\d", "openai"), (r"gemini", "google"))
FAMILIES = ((r"claude", "claude"), (r"gpt|^o\d", "gpt"))
CACHING_PROVIDERS = ("anthropic", "openai")
TTFT_TOKENS_PER_SECOND = 25_000

# --- fixed values: thresholds of the detectors ------------------------------------------
LARGE_TOOL_RESULT_TOKENS = 2000
HUGE_TOOL_RESULT_TOKENS = 8000
LARGE_TOOL_RESULT_RECOVERY = 0.8
DUPLICATE_MIN_CHARS = 300
BLOB_RECOVERY = 0.9
LONG_HISTORY_TURNS = 40
LONG_HISTORY_RECOVERY = 0.7
SYSTEM_SHARE = 0.25
SYSTEM_TOKENS = 2000
WINDOW_WARN_PCT = 70
WINDOW_HIGH_PCT = 90
LARGEST_MESSAGES = 5
PREVIEW_CHARS = 90
SEVERITY_RANK = {"high": 0, "warn": 1, "info": 2}
FINDING_ORDER = (
    "large_tool_result",
    "duplicate_content",
    "repeated_tool_call",
    "base64_blob",
    "long_history",
    "large_system_prompt",
    "cache_ordering",
    "near_window_limit",
)

# --- fixed values: wording of the findings ----------------------------------------------
FINDING_MESSAGES = {
    "large_tool_result": "Tool result at message #%s%s is ~%s tokens.",
    "duplicate_content": "Message #%s duplicates the content of message #%s (~%s tokens).",
    "repeated_tool_call": "The same tool call (with identical arguments) appears %s times (messages #%s).",
    "base64_blob": "Message #%s contains a base64/binary blob (~%s tokens of mostly meaningless characters).",
    "long_history": "Conversation has %s turns; the older half holds ~%s tokens.",
    "large_system_prompt": "System prompt is ~%s tokens (%s%% of the context).",
    "cache_ordering": "Prompt caching only matches a byte-identical prefix.",
    "near_window_limit": "Context is at ~%s%% of %s's window.",
}
FINDING_SUGGESTIONS = {
    "large_tool_result": "Truncate or summarize large tool outputs before they enter history; keep only the fields the model actually used.",
    "duplicate_content": "Replace repeated content with a short reference to the first occurrence.",
    "repeated_tool_call": "Repeated identical calls usually mean the earlier result scrolled out of the model's attention — cache results or surface them in a compact recap instead of re-calling.",
    "base64_blob": "Never put base64 in text content — use the provider's file/image APIs or replace with a file reference.",
    "long_history": "Summarize the older half of the conversation into a compact recap and drop the raw turns (prune-history strategy).",
    "large_system_prompt": "A big system prompt is fine IF it is stable — put it first and use prompt caching (Anthropic: cache_control; OpenAI: automatic prefix caching) so you stop paying full price for it every call.",
    "cache_ordering": "Keep stable content (system prompt, tool definitions, reference docs) at the start and never interleave it with per-request content — a single changed byte early in the prompt invalidates the cache for everything after it.",
    "near_window_limit": "Models degrade well before the hard limit (lost-in-the-middle). Compact now rather than when the request fails.",
}

# --- fixed values: rewriting strategies -------------------------------------------------
STRATEGIES = ("strip-base64", "dedupe", "trim-tool-results", "prune-history")
DEFAULT_STRATEGIES = ("strip-base64", "dedupe", "trim-tool-results")
KEEP_RECENT = 6
MAX_TOOL_RESULT_TOKENS = 300
STRIP_MIN_SAVING = 50
DIGEST_CHARS = 200
# Name shown inside inserted markers.  Fourteen characters with one hyphen, so that marker
# token counts equal the published expectations; any other name may be passed.
MARKER_NAME = "context-shaper"
BLOB_MARKER = "[%s: base64 blob removed — use file/image APIs instead]"
DUPLICATE_MARKER = "[%s: identical to message #%s — content removed]"
TRIM_MARKER = "\n…[%s: trimmed %s chars of stale tool output]"
PRUNE_MARKER = (
    "[%s: %s earlier messages (~%s tokens) pruned. "
    "Replace this stub with an LLM-written summary of those turns for best results.]"
)
REMOVED_BLOCK = "[removed]"
CHANGE_NOTES = {
    "strip-base64": "Removed inline base64 data",
    "dedupe": "Duplicate of message #%s",
    "trim-tool-results": "Stale tool result truncated",
    "prune-history": "Pruned %s old messages",
}

# --- fixed values: sessions, alerts, ledger, requests -----------------------------------
SESSION_LIST_LIMIT = 20
IMPACT_SESSION_LIMIT = 8
IMPACT_MAX_SESSION_BYTES = 30 * 1024 * 1024
SESSION_KEY_CHARS = 12
LEDGER_MAX_BYTES = 256 * 1024
LEDGER_KEEP_ENTRIES = 500
ALERT_WARN_TOKENS = 80_000
ALERT_REGROWTH = 1.4
ALERT_BYTES_PER_TOKEN = 4
ALERT_STATE_SESSIONS = 100
ALERT_SIZE_LINE = "This session's context is at ~%s tokens%s%s."
ALERT_HYGIENE_LINE = "Practice context hygiene from here on: summarize large tool results instead of keeping them verbatim, reference earlier content rather than re-reading or re-quoting it, and keep responses lean."
ALERT_WASTE_LINE = "Largest recoverable waste: %s (%s)"
ALERT_COMPACTION_LINE = "If it fits the flow, offer the user a compaction of the older history."
ROUTES = (
    ("/v1/messages", "anthropic"),
    ("/v1/chat/completions", "openai"),
    ("/v1/responses", "openai"),
    ("/v1/embeddings", "openai"),
)
MEASUREMENT_ROUTE = "/v1/messages/count_tokens"
BAR_WIDTH = 28
