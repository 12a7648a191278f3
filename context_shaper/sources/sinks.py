"""Results as JSON lines or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def as_json(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One JSON document per row, beside its key."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode(mode).text(path)


def write_table(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).parquet(path)
