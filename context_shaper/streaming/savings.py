"""Savings by stretches of time, from the ledger as it grows.

Optimize events are summed per window of event time and model.  A window is final once the watermark, the
greatest time seen less a delay, has passed its end.  Lines that still come for it are late: Spark's own
``withWatermark`` would drop them without a trace, so the watermark is kept here, a stored number per batch,
and late lines go to a table of their own.  Sums are stored per batch too and added up when read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from context_shaper.operators.impact import family_savings, optimizations
from context_shaper.sources import folders

DAY_MS = 86_400_000


def window_start(ts: Column, width_ms: int) -> Column:
    """Start of the window that a time in milliseconds lies in."""
    return (F.floor(ts / F.lit(width_ms)) * F.lit(width_ms)).cast("bigint")


def savings_by_window(ledger: DataFrame, width_ms: int = DAY_MS) -> DataFrame:
    """(start, family, run_count, tokens_saved, usd_saved) per window of time; batch counterpart of the stream."""
    per_model = optimizations(ledger).groupBy(window_start(F.col("ts"), width_ms).alias("start"), "model").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.coalesce("saved", F.lit(0))).alias("saved")
    )
    return family_savings(per_model, ["start"])


def windowed_savings_stream(
    ledger: DataFrame, path: str, delay_ms: int, width_ms: int = DAY_MS, **trigger
) -> StreamingQuery:
    """Sum optimize events per window and model; lines later than ``delay_ms`` go to a table of their own.

    The watermark of a batch is the greatest time of all batches before it less the delay.  Each batch stores, under its number, the sums of its lines in open windows, the lines
    for windows that were closed, and the greatest time so far.  A batch that is run again starts from
    what the batch before stored, and replaces its own folders by the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        watermark = _watermark(spark, path, batch_id, delay_ms)
        rows = optimizations(batch).withColumn("start", window_start(F.col("ts"), width_ms))
        late = F.col("start") + F.lit(width_ms) <= F.lit(watermark)
        sums = rows.filter(~late).groupBy("start", "model").agg(
            F.count(F.lit(1)).alias("runs"), F.sum(F.coalesce("saved", F.lit(0))).alias("saved")
        )
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch_id={batch_id}")
        rows.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        greatest = rows.agg(F.max("ts").alias("ts"))
        greatest.write.mode("overwrite").parquet(f"{path}/times/batch_id={batch_id}")

    return (
        ledger.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _before(spark: SparkSession, path: str, name: str, batch_id: int) -> DataFrame | None:
    """What batches before this one stored under a name."""
    numbers = [int(x.split("=")[1]) for x in folders.subfolders(spark, f"{path}/{name}")]
    paths = [f"{path}/{name}/batch_id={number}" for number in numbers if number < batch_id]
    return spark.read.parquet(*paths) if paths else None


def _watermark(spark: SparkSession, path: str, batch_id: int, delay_ms: int) -> int:
    times = _before(spark, path, "times", batch_id)
    greatest = None if times is None else times.agg(F.max("ts")).first()[0]
    return 0 if greatest is None else max(greatest - delay_ms, 0)


def window_totals(spark: SparkSession, path: str, delay_ms: int, batch_id: int, width_ms: int = DAY_MS) -> DataFrame:
    """(start, family, run_count, tokens_saved, usd_saved, final) after a batch; final windows change no more."""
    sums = _before(spark, path, "sums", batch_id + 1)
    per_model = sums.groupBy("start", "model").agg(F.sum("runs").alias("runs"), F.sum("saved").alias("saved"))
    watermark = _watermark(spark, path, batch_id + 1, delay_ms)
    return family_savings(per_model, ["start"]).withColumn("final", F.col("start") + F.lit(width_ms) <= F.lit(watermark))


def late_entries(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The ledger lines that came for windows that were final."""
    return _before(spark, path, "late", batch_id + 1).drop("start")
