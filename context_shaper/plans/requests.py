"""Captured requests: optimize each body, and total what that saved."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from context_shaper.functions import models as M
from context_shaper.functions.display import fill_template, format_tokens
from context_shaper.operators.normalize import conversations, normalize
from context_shaper.operators.rewrite import RewriteOptions
from context_shaper.operators.writeback import rewrite_documents
from context_shaper.plans.optimize import Optimized, optimize
from context_shaper.sources.requests import route, supported


def request_bodies(requests: DataFrame) -> DataFrame:
    """Bodies to optimize, as documents keyed by request id."""
    rows = route(requests).filter("may_optimize")
    return rows.select(F.col("request_id").cast("string").alias("conv_id"), "body")


def optimize_requests(
    requests: DataFrame, options: RewriteOptions = RewriteOptions(), staged: bool = True
) -> Optimized:
    return optimize(normalize(request_bodies(requests)), options, staged)


def request_results(requests: DataFrame, result: Optimized) -> DataFrame:
    """One row per supported request, passed through or optimized.

    ``parsed`` tells bodies that hold a message list; only those count in before and after.
    """
    bodies = conversations(request_bodies(requests)).filter("has_list").select(
        "conv_id", F.col("body_model").alias("model"), F.lit(True).alias("parsed")
    )
    savings = result.savings.select(
        "conv_id", "tokens_before", "tokens_after", "tokens_saved", "change_count"
    )
    measured = bodies.join(savings, "conv_id", "left").fillna(
        0, ["tokens_before", "tokens_after", "tokens_saved", "change_count"]
    )
    rows = supported(route(requests)).select(
        F.col("request_id").cast("string").alias("conv_id"), "method", "path", "upstream"
    ).join(measured, "conv_id", "left")
    saved = F.coalesce("tokens_saved", F.lit(0))
    optimized = saved > 0
    note = (
        F.when(
            optimized,
            fill_template(
                "optimized %s → %s tokens (%s changes)", format_tokens(F.col("tokens_before")),
                format_tokens(F.col("tokens_after")), F.col("change_count"),
            ),
        )
        .when(F.col("parsed"), "clean (nothing to save)")
        .otherwise("passthrough")
    )
    return rows.select(
        F.col("conv_id").alias("request_id"), "method", "path", "upstream", "model",
        F.coalesce("parsed", F.lit(False)).alias("parsed"),
        F.coalesce("tokens_before", F.lit(0)).alias("tokens_before"),
        F.coalesce("tokens_after", F.lit(0)).alias("tokens_after"),
        F.when(optimized, saved).otherwise(F.lit(0)).alias("tokens_saved"),
        F.when(optimized, M.input_cost_usd(saved, M.input_price(F.col("model")))).alias("usd_saved"),
        note.alias("note"),
    )


def forwarded_bodies(requests: DataFrame, result: Optimized) -> DataFrame:
    """request_id, body as sent on: rewritten only where that saves tokens."""
    saving = result.savings.filter(F.col("tokens_saved") > 0).select("conv_id")
    edits = result.rewritten.join(saving, "conv_id", "left_semi")
    points = None if result.points is None else result.points.join(saving, "conv_id", "left_semi")
    raw = supported(route(requests)).select(F.col("request_id").alias("conv_id"), "body")
    return rewrite_documents(raw, edits, points).withColumnRenamed("conv_id", "request_id")


def request_totals(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Running totals over request results; works on a table or (in complete mode) a stream."""
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("tokens_saved") > 0).alias("optimized_requests"),
        F.coalesce(F.sum("tokens_before"), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("tokens_after"), F.lit(0)).alias("tokens_after"),
        F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"),
        F.coalesce(F.sum("usd_saved"), F.lit(0.0)).alias("usd_saved"),
    )
