"""The activity ledger: JSON lines of check and optimize events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from context_shaper import fixed_values as V
from context_shaper.operators.ordering import newest_rows
from context_shaper.sources.documents import is_json

LEDGER_SCHEMA = (
    "ts bigint, ev string, sid string, tok bigint, warn boolean, src string, saved bigint, model string"
)


def parse_ledger(lines: DataFrame) -> DataFrame:
    """lines(value) -> ledger rows; bad lines are dropped, a missing event means ``check``.

    Works on a batch or a stream.
    """
    entry = F.from_json("value", f"struct<{LEDGER_SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    rows = lines.filter(is_json(F.col("value"))).withColumn("entry", entry).select("entry.*")
    return rows.withColumn("ev", F.coalesce("ev", F.lit("check")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return parse_ledger(lines).withColumn("seq", F.monotonically_increasing_id())


def check_entries(decisions: DataFrame, key_chars: int | None = V.SESSION_KEY_CHARS) -> DataFrame:
    """Ledger rows for the deep checks of the alert operator.

    Session ids are cut to ``key_chars``; None keeps them whole, for a ledger of so many sessions that
    some begin alike.
    """
    session = F.col("session_id") if key_chars is None else F.substring("session_id", 1, key_chars)
    return decisions.filter("deep_check").select(
        "ts", F.lit("check").alias("ev"), session.alias("sid"),
        F.col("tokens").alias("tok"), "warn",
    )


def optimize_entries(summary: DataFrame, source: str, ts) -> DataFrame:
    """Ledger rows for rewriting runs that saved something."""
    return summary.filter(F.col("tokens_saved") > 0).select(
        ts.cast("bigint").alias("ts"), F.lit("optimize").alias("ev"), F.lit(source).alias("src"),
        F.col("tokens_saved").alias("saved"), "model",
    )


def append_ledger(entries: DataFrame, path: str) -> None:
    """Append entries as JSON lines; absent fields are left out."""
    fields = [name for name in entries.columns if name != "seq"]
    entries.select(F.to_json(F.struct(*fields)).alias("value")).write.mode("append").text(path)


def retained(ledger: DataFrame, keep: int = V.LEDGER_KEEP_ENTRIES, owner: str | None = None) -> DataFrame:
    """The most recent entries; in a ledger of a whole fleet, of each ``owner``."""
    return newest_rows(ledger, [F.desc("ts"), F.desc("seq")], keep, owner)


def compact_ledger(
    spark: SparkSession,
    path: str,
    target: str,
    max_bytes: int = V.LEDGER_MAX_BYTES,
    keep: int = V.LEDGER_KEEP_ENTRIES,
) -> bool:
    """Write the retained entries to ``target`` if the ledger outgrew ``max_bytes``."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size <= max_bytes:
        return False
    append_ledger(retained(read_ledger(spark, path), keep), target)
    return True
