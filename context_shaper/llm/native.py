"""Small helpers for expressions that stay inside the engine's built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def version(text: Column) -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(text)


def doc_key(doc_id: Column, text: Column) -> Column:
    """What rows must share to count as one document; a missing doc_id is a value like any other."""
    return F.struct(doc_id.cast("bigint").alias("doc_id"), version(text).alias("version"))
