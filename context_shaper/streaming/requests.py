"""Requests optimized as they arrive, and their running totals.

Two streams, each with its own checkpoint.  The first optimizes every micro-batch and puts its results
under ``batch_id=N``, a whole folder at a time and only once.  The second reads those folders and keeps
the totals as streaming aggregation state, so they go on where they were after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from context_shaper.operators.rewrite import RewriteOptions
from context_shaper.plans.requests import forwarded_bodies, optimize_requests, request_results, request_totals
from context_shaper.sources import folders

RESULT_SCHEMA = (
    "request_id string, method string, path string, upstream string, model string, parsed boolean, "
    "tokens_before bigint, tokens_after bigint, tokens_saved bigint, usd_saved double, note string"
)


def write_once(rows: DataFrame, path: str, batch_id: int) -> bool:
    """Write a batch to ``batch_id=N``; False if it is there already.

    The rows go to a draft that readers do not see, which then gets its name in one step.
    """
    spark, folder = rows.sparkSession, f"{path}/batch_id={batch_id}"
    if folders.exists(spark, folder):
        return False
    draft = f"{path}/_drafts/{batch_id}"
    rows.write.mode("overwrite").parquet(draft)
    return folders.publish(spark, draft, folder)


def optimize_request_stream(
    requests: DataFrame,
    results_path: str,
    checkpoint: str,
    options: RewriteOptions = RewriteOptions(),
    bodies_path: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Optimize each micro-batch; write results (and bodies) per batch.

    A batch that is run again finds its folder and leaves it as it is, so that whoever has read the
    folder sees no doubles.  ``requests`` itself must hold no stateful operator.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        result = optimize_requests(batch, options)
        write_once(request_results(batch, result), results_path, batch_id)
        if bodies_path:
            write_once(forwarded_bodies(batch, result), bodies_path, batch_id)

    return (
        requests.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def request_result_stream(spark: SparkSession, results_path: str) -> DataFrame:
    """The results that ``optimize_request_stream`` writes, as a stream; it may start before the first batch."""
    folders.make(spark, results_path)
    return spark.readStream.schema(f"{RESULT_SCHEMA}, batch_id bigint").parquet(results_path).drop("batch_id")


def running_totals_stream(
    results: DataFrame, totals_path: str, checkpoint: str, by: list[str] | None = None, **trigger
) -> StreamingQuery:
    """After every trigger the totals of all requests so far, under ``batch_id=N``.

    The counters since the start are aggregation state, one row per group, kept in the checkpoint.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{totals_path}/batch_id={batch_id}")

    return (
        request_totals(results, by).writeStream.outputMode("complete").foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def running_totals(spark: SparkSession, totals_path: str) -> DataFrame:
    """The totals after each trigger that had requests, with its ``batch_id``."""
    return spark.read.option("basePath", totals_path).parquet(f"{totals_path}/batch_id=*")
