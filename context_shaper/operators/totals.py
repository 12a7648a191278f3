"""Per-conversation aggregates: totals, categories, largest messages, cost and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from context_shaper import fixed_values as V
from context_shaper.functions import models as M
from context_shaper.functions.display import percent_of, round_half_up, share_bar
from context_shaper.operators.normalize import source_format
from context_shaper.operators.ordering import CHUNK_ROWS, join_conversations, top_rows


def category_tokens(measured: DataFrame) -> DataFrame:
    """Long form: conv_id, category, tokens, for categories that occur."""
    return measured.groupBy("conv_id", "category").agg(F.sum("tokens").alias("tokens"))


def category_shares(measured: DataFrame) -> DataFrame:
    """Report rows: label, tokens, share, whole percent and bar per occurring category."""
    totals = measured.groupBy("conv_id").agg(F.sum("tokens").alias("total_tokens"))
    rows = category_tokens(measured).filter(F.col("tokens") > 0).join(totals, "conv_id")
    label = F.create_map(*[F.lit(x) for pair in V.CATEGORY_LABELS.items() for x in pair])
    share = F.col("tokens").cast("double") / F.col("total_tokens").cast("double")
    return rows.select(
        "conv_id", "category",
        label[F.col("category")].alias("label"),
        "tokens",
        share.alias("share"),
        round_half_up(share * F.lit(100.0)).alias("share_pct"),
        share_bar(share).alias("bar"),
    )


def turn_test(kind: Column) -> Column:
    return kind.isin("user", "assistant")


def conversation_totals(
    measured: DataFrame, conversations: DataFrame | None = None
) -> DataFrame:
    """One row per conversation from one partially combined aggregation.

    With ``conversations`` (from ``normalize.conversations``) empty ones get a row of zeros.
    """
    sums = [
        F.sum(F.when(F.col("category") == name, F.col("tokens")).otherwise(F.lit(0)))
        .cast("bigint")
        .alias(f"{name}_tokens")
        for name in V.CATEGORIES
    ]
    # These three are the same for every message of a conversation; as grouping keys they keep
    # the aggregation buffer numeric, which lets Spark aggregate by hash instead of by sort.
    constant = ["conv_id", "model", "doc_format", "has_system"]
    rows = measured.groupBy(*constant).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(turn_test(F.col("kind"))).alias("turn_count"),
        F.sum("tokens").alias("total_tokens"),
        *sums,
        F.max("has_tool_block").alias("has_tool_block"),
    )
    totals = rows.select(
        "conv_id",
        "model",
        source_format(F.col("doc_format"), F.col("has_system"), F.col("has_tool_block")).alias("source_format"),
        "message_count", "turn_count", "total_tokens",
        *[f"{name}_tokens" for name in V.CATEGORIES],
    )
    if conversations is None:
        return totals
    empty = conversations.filter(F.col("message_count") == 0).select(
        "conv_id", "model", "source_format"
    )
    counts = [name for name, kind in totals.dtypes if kind == "bigint"]
    return totals.unionByName(empty, allowMissingColumns=True).fillna(0, counts)


def with_window_usage(totals: DataFrame, model: str | None = None) -> DataFrame:
    """Adds model (the caller's one wins), context_window and usage_pct."""
    chosen = F.lit(model) if model else F.col("model")
    return (
        totals.withColumn("model", F.when(chosen != "", chosen))
        .withColumn("context_window", M.context_window(F.col("model")))
        .withColumn(
            "usage_pct",
            F.col("total_tokens").cast("double") / F.col("context_window").cast("double") * F.lit(100.0),
        )
    )


def largest_messages(measured: DataFrame, count: int = V.LARGEST_MESSAGES) -> DataFrame:
    """The biggest messages per conversation, earlier ones first among equals."""
    narrow = measured.select(
        "conv_id", "pos", "msg_index", "role", "kind", "tool_name", "tokens", "preview"
    )
    return top_rows(narrow, "conv_id", [F.desc("tokens"), F.asc("pos")], count, "rank").drop("pos")


def older_half_tokens(
    measured: DataFrame, totals: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Tokens in the first floor(n / 2) messages of the given conversations."""
    facts = totals.select("conv_id", "message_count")
    rows = join_conversations(
        measured.select("conv_id", "pos", "tokens"), facts, "message_count", "pos", chunk_rows=chunk_rows
    )
    older = F.col("pos") < F.floor(F.col("message_count") / 2)
    return rows.groupBy("conv_id").agg(
        F.sum(F.when(older, F.col("tokens")).otherwise(F.lit(0))).cast("bigint").alias("older_tokens")
    )


def cost_struct(tokens: Column, savings: Column, price: Column) -> Column:
    """Six figures per call and per thousand calls; null when the model has no known price."""
    per_call, saved = M.input_cost_usd(tokens, price), M.input_cost_usd(savings, price)
    return F.when(
        price.isNotNull(),
        F.struct(
            per_call.alias("per_call_usd"),
            (per_call * F.lit(1000.0)).alias("per_1k_calls_usd"),
            saved.alias("savings_per_call_usd"),
            (saved * F.lit(1000.0)).alias("savings_per_1k_calls_usd"),
            M.ttft_seconds(tokens).alias("ttft_seconds"),
            M.ttft_seconds(savings).alias("ttft_saved_seconds"),
        ),
    )


def waste_pct(savings: Column, total: Column) -> Column:
    return percent_of(savings, total)
