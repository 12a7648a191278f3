"""Detectors: each returns rows of one common ``findings`` shape.

A finding that involves many messages is cut into parts of bounded size: ``part`` 0, 1, ...
carry the message indexes of consecutive position ranges, and part 0 stands for the finding
when findings are counted.  Conversations within one range always have a single part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from context_shaper import fixed_values as V
from context_shaper.functions import models as M
from context_shaper.functions.display import fill_template, format_tokens, round_half_up, to_fixed
from context_shaper.operators.ordering import (
    CHUNK_ROWS,
    members_of_repeated_groups,
    union_all,
)
from context_shaper.operators.totals import (
    conversation_totals,
    older_half_tokens,
    with_window_usage,
)

FINDING_COLUMNS = [
    "conv_id", "finding", "severity", "est_savings", "message", "suggestion", "messages",
    "detector_no", "first_pos", "part",
]


@dataclass(frozen=True)
class Thresholds:
    large_tool_result_tokens: int = V.LARGE_TOOL_RESULT_TOKENS
    huge_tool_result_tokens: int = V.HUGE_TOOL_RESULT_TOKENS
    long_history_turns: int = V.LONG_HISTORY_TURNS
    system_share: float = V.SYSTEM_SHARE
    system_tokens: int = V.SYSTEM_TOKENS
    window_warn_pct: float = V.WINDOW_WARN_PCT
    window_high_pct: float = V.WINDOW_HIGH_PCT
    chunk_rows: int = CHUNK_ROWS


def _finding(
    rows: DataFrame,
    name: str,
    severity: Column | str,
    savings: Column | int,
    message: list[Column],
    indexes: Column | None = None,
    first_pos: Column | None = None,
    part: Column | None = None,
) -> DataFrame:
    none = F.array().cast("array<bigint>")
    return rows.select(
        "conv_id",
        F.lit(name).alias("finding"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (F.lit(savings) if isinstance(savings, int) else savings).cast("bigint").alias("est_savings"),
        fill_template(V.FINDING_MESSAGES[name], *message).alias("message"),
        F.lit(V.FINDING_SUGGESTIONS[name]).alias("suggestion"),
        (none if indexes is None else indexes).alias("messages"),
        F.lit(V.FINDING_ORDER.index(name) + 1).alias("detector_no"),
        (F.lit(0) if first_pos is None else first_pos).cast("bigint").alias("first_pos"),
        (F.lit(0) if part is None else part).cast("bigint").alias("part"),
    )


def share_of_tokens(factor: float) -> Column:
    return round_half_up(F.col("tokens").cast("double") * F.lit(factor))


def large_tool_results(measured: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    rows = measured.filter(
        (F.col("kind") == "tool_result") & (F.col("tokens") > limits.large_tool_result_tokens)
    )
    tool = F.when(
        F.col("tool_name").isNotNull() & (F.col("tool_name") != ""),
        F.concat(F.lit(" ("), F.col("tool_name"), F.lit(")")),
    ).otherwise("")
    return _finding(
        rows, "large_tool_result",
        F.when(F.col("tokens") > limits.huge_tool_result_tokens, "high").otherwise("warn"),
        share_of_tokens(V.LARGE_TOOL_RESULT_RECOVERY),
        [F.col("msg_index"), tool, F.col("tokens")],
        F.array("msg_index"), F.col("pos"),
    )


def duplicate_members(measured: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Later copies of a text inside a conversation, with the first copy's position."""
    rows = measured.filter(F.col("content_key").isNotNull()).select(
        "conv_id", "content_key", "pos", "msg_index", "tokens"
    )
    members = members_of_repeated_groups(
        rows, ["conv_id", "content_key"], "pos", limits.chunk_rows
    )
    return members.filter(F.col("pos") > F.col("first_position"))


def duplicate_content(measured: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    copies = duplicate_members(measured, limits)
    # The system prompt shifts positions against message indexes by a constant.
    first_index = F.col("first_position") + F.col("msg_index") - F.col("pos")
    return _finding(
        copies, "duplicate_content", "warn",
        F.col("tokens") - V.MESSAGE_OVERHEAD_TOKENS,
        [F.col("msg_index"), first_index, F.col("tokens")],
        F.array(first_index, F.col("msg_index")), F.col("pos"),
    )


def repeated_tool_calls(measured: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    rows = measured.filter(F.col("call_key").isNotNull()).select(
        "conv_id", "call_key", "pos", "msg_index"
    )
    members = members_of_repeated_groups(rows, ["conv_id", "call_key"], "pos", limits.chunk_rows)
    # The join left rows clustered by (conversation, call, chunk); lists stay below chunk size.
    groups = members.groupBy("conv_id", "call_key", "_chunk").agg(
        F.max("group_rows").alias("group_rows"),
        F.max("first_position").alias("first_position"),
        F.max("part").alias("part"),
        F.array_sort(F.collect_list("msg_index")).alias("indexes"),
    )
    return _finding(
        groups, "repeated_tool_call", "info", 0,
        [F.col("group_rows"), F.array_join(F.col("indexes").cast("array<string>"), ", #")],
        F.col("indexes"), F.col("first_position"), F.col("part"),
    )


def base64_blobs(measured: DataFrame) -> DataFrame:
    return _finding(
        measured.filter("has_blob"), "base64_blob", "high",
        share_of_tokens(V.BLOB_RECOVERY),
        [F.col("msg_index"), F.col("tokens")],
        F.array("msg_index"), F.col("pos"),
    )


def long_histories(
    measured: DataFrame, totals: DataFrame, limits: Thresholds = Thresholds()
) -> DataFrame:
    long = totals.filter(F.col("turn_count") > limits.long_history_turns)
    rows = long.join(older_half_tokens(measured, long, limits.chunk_rows), "conv_id")
    return _finding(
        rows, "long_history", "warn",
        round_half_up(F.col("older_tokens").cast("double") * F.lit(V.LONG_HISTORY_RECOVERY)),
        [F.col("turn_count"), F.col("older_tokens")],
    )


def large_system_prompts(totals: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    share = F.when(
        F.col("total_tokens") > 0,
        F.col("system_tokens").cast("double") / F.col("total_tokens").cast("double"),
    )
    rows = totals.withColumn("system_share", share).filter(
        (F.col("system_share") > limits.system_share) & (F.col("system_tokens") > limits.system_tokens)
    )
    percent = round_half_up(F.col("system_share") * F.lit(100.0))
    return _finding(rows, "large_system_prompt", "info", 0, [F.col("system_tokens"), percent])


def cache_orderings(totals: DataFrame) -> DataFrame:
    rows = totals.filter(M.provider(F.col("model")).isin(*V.CACHING_PROVIDERS))
    return _finding(rows, "cache_ordering", "info", 0, [])


def window_pressure(totals: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    rows = totals.filter(F.col("usage_pct") > limits.window_warn_pct)
    return _finding(
        rows, "near_window_limit",
        F.when(F.col("usage_pct") > limits.window_high_pct, "high").otherwise("warn"), 0,
        [to_fixed(F.col("usage_pct"), 0), F.col("model")],
    )


def all_findings(
    measured: DataFrame,
    model: str | None = None,
    limits: Thresholds = Thresholds(),
    conversations: DataFrame | None = None,
) -> DataFrame:
    """Every finding of every conversation.  ``measured`` is read several times: stage it."""
    totals = with_window_usage(conversation_totals(measured, conversations), model)
    return union_all([
        large_tool_results(measured, limits),
        duplicate_content(measured, limits),
        repeated_tool_calls(measured, limits),
        base64_blobs(measured),
        long_histories(measured, totals, limits),
        large_system_prompts(totals, limits),
        cache_orderings(totals),
        window_pressure(totals, limits),
    ])


def severity_rank(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in V.SEVERITY_RANK.items() for x in pair])[severity]


def report_order() -> list[Column]:
    """Severity first, then savings, then detector and message order."""
    return [
        severity_rank(F.col("severity")).asc(), F.col("est_savings").desc(),
        F.col("detector_no").asc(), F.col("first_pos").asc(), F.col("message").asc(), F.col("part").asc(),
    ]


def ordered_findings(findings: DataFrame) -> DataFrame:
    """A total order over all conversations; range partitioning splits even a hot one."""
    return findings.orderBy(F.col("conv_id"), *report_order())


def ranked_findings(findings: DataFrame, count: int | None = None) -> DataFrame:
    """All findings per conversation, or the first ``count``, ranked from 1.

    A finding that comes in parts has one rank: severity, savings, detector and first message are the
    same for its parts and for no other finding.
    """
    window = Window.partitionBy("conv_id").orderBy(*report_order()[:4])
    ranked = findings.withColumn("rank", F.dense_rank().over(window))
    return ranked if count is None else ranked.filter(F.col("rank") <= count)


def finding_totals(findings: DataFrame) -> DataFrame:
    """Savings and counts per conversation.  Overlapping savings add up, on purpose."""
    whole = F.col("part") == 0
    return findings.groupBy("conv_id").agg(
        F.sum("est_savings").alias("total_est_savings"),
        F.count_if(whole).alias("finding_count"),
        *[
            F.count_if(whole & (F.col("severity") == level)).alias(f"{level}_count")
            for level in V.SEVERITY_RANK
        ],
    )


def top_recoverable(findings: DataFrame) -> DataFrame:
    """The first finding with savings in report order, by a combinable minimum."""
    key = F.struct(
        severity_rank(F.col("severity")).alias("rank"),
        (-F.col("est_savings")).alias("savings"),
        F.col("detector_no"), F.col("first_pos"),
        F.col("message"), F.col("suggestion"), F.col("finding"), F.col("est_savings"),
    )
    best = findings.filter(F.col("est_savings") > 0).groupBy("conv_id").agg(F.min(key).alias("top"))
    return best.select(
        "conv_id",
        F.col("top.finding").alias("top_finding"),
        F.col("top.est_savings").alias("top_savings"),
        F.col("top.message").alias("top_message"),
        F.col("top.suggestion").alias("top_suggestion"),
    )


def savings_label(savings: Column) -> Column:
    return F.when(
        savings > 0, F.concat(F.lit(" [save ~"), format_tokens(savings), F.lit("]"))
    ).otherwise("")
