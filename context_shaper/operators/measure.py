"""The narrow per-message table everything else is computed from.

One pass over the texts turns each message into a few numbers, two hashes, a flag and a short
preview.  Long texts stop here: no shuffle of the profiler carries them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from context_shaper import fixed_values as V
from context_shaper.functions import text as T
from context_shaper.operators.normalize import category_of
from context_shaper.operators.ordering import compute_once


FEATURES = ("chars", "tokens", "content_key", "call_key", "has_blob", "preview")


def measure(
    messages: DataFrame,
    features: tuple[str, ...] = FEATURES,
    duplicate_min_chars: int = V.DUPLICATE_MIN_CHARS,
    preview_chars: int = V.PREVIEW_CHARS,
) -> DataFrame:
    """messages -> measured(conv_id, pos, msg_index, role, kind, category, tokens, ...).

    ``tokens`` includes the per-message overhead.  ``content_key`` is null for texts too short
    to count as duplicates, ``call_key`` is null for anything but tool calls.  Features cost a
    pass over the text each: name just those that are needed (totals need ``tokens`` only).
    """
    text = F.col("text")
    carried = [
        "role", "kind", "tool_name", "has_binary", "has_tool_block", "doc_format", "has_system",
    ]
    available = {
        "chars": T.utf16_length(text),
        "tokens": T.estimate_tokens(text) + V.MESSAGE_OVERHEAD_TOKENS,
        "content_key": F.when(T.utf16_length(text) >= duplicate_min_chars, T.content_hash(text)),
        "call_key": F.when(
            (F.col("kind") == "tool_call") & F.col("tool_call_text").isNotNull(),
            T.content_hash(F.col("tool_call_text")),
        ),
        "has_blob": T.has_blob(text),
        "preview": T.preview(text, preview_chars),
    }
    return compute_once(
        messages,
        ["conv_id", "pos", "msg_index", "model"],
        {name: F.col(name) for name in carried}
        | {"category": category_of(F.col("kind"))}
        | {name: available[name] for name in features},
    )
