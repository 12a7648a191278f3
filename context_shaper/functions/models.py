"""Column functions over model names: context window, provider, price, family, cost.

Each lookup is an ordered list of case-insensitive patterns with the first match winning,
expressed as one CASE chain.  Apply them to per-conversation rows, not to every message.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from context_shaper import fixed_values as V


def _first_match(model: Column, entries, value) -> Column:
    chain = None
    for pattern, entry in entries:
        test = model.rlike("(?i)" + pattern)
        result = value(entry)
        chain = F.when(test, result) if chain is None else chain.when(test, result)
    return chain


def context_window(model: Column) -> Column:
    """Window size in tokens; null for an unknown model."""
    return _first_match(model, V.MODEL_WINDOWS, lambda size: F.lit(size).cast("bigint"))


def provider(model: Column) -> Column:
    return F.coalesce(_first_match(model, V.PROVIDERS, F.lit), F.lit("generic"))


def model_family(model: Column) -> Column:
    return F.coalesce(_first_match(model, V.FAMILIES, F.lit), F.lit("other"))


def input_price(model: Column) -> Column:
    """USD per million input tokens; null when no price is known."""
    return _first_match(model, V.MODEL_PRICES, lambda price: F.lit(price[0]))


def pricing(model: Column) -> Column:
    """Struct of the three prices; null when no price is known."""
    return _first_match(
        model,
        V.MODEL_PRICES,
        lambda price: F.struct(
            F.lit(price[0]).alias("input_per_m"),
            F.lit(price[1]).alias("output_per_m"),
            F.lit(price[2]).alias("cache_read_per_m"),
        ),
    )


def input_cost_usd(tokens: Column, price: Column) -> Column:
    return tokens.cast("double") / F.lit(1e6) * price


def ttft_seconds(tokens: Column) -> Column:
    return tokens.cast("double") / F.lit(float(V.TTFT_TOKENS_PER_SECOND))
