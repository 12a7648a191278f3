"""The impact report kept up to date while the ledger grows, late lines included.

Three streams over the same ledger lines: activity per session, counts of checks, savings per model.
Activity needs the order of a session's checks, and lines may come late, so every check is kept, four numbers
each: those of a session with few in one entry, else in buckets of time, beside an index with a few sums
per bucket.  A trigger opens the one entry, or the buckets it has lines of and the index, whatever a session's past.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from context_shaper.operators.impact import checks, family_savings, measured_checks, model_savings
from context_shaper.streaming.watch import plain_strings

BUCKET_MS = 3_600_000
SMALL_CHECKS = 1024
_ACTIVITY = "sid string, check_count bigint, warn_count bigint, reduction bigint"


def _numbers(packed, width: int) -> np.ndarray:
    return np.frombuffer(bytes(packed), np.int64).reshape(-1, width)


def _drops(tokens: np.ndarray) -> int:
    return int(np.maximum(tokens[:-1] - tokens[1:], 0).sum())


class ActivityProcessor(StatefulProcessor):
    """Checks, warnings and observed shrinkage of a session; one row per trigger that brought checks."""

    def __init__(self, bucket_ms: int, small: int = SMALL_CHECKS) -> None:
        self._bucket_ms, self._limit = bucket_ms, small

    def init(self, handle: StatefulProcessorHandle) -> None:
        # All checks of a session that has few of them.
        self._small = handle.getValueState("small", "checks binary")
        # Per bucket: its number, first and last token count, drops inside, checks, warnings.
        self._index = handle.getValueState("index", "buckets binary")
        # Per check: time, place in the ledger, tokens, warning.
        self._checks = handle.getMapState("checks", "bucket bigint", "checks binary")

    def _bucket(self, number: int, added: np.ndarray) -> list[int]:
        known = self._checks.containsKey((number,))
        every = np.concatenate([_numbers(self._checks.getValue((number,))[0], 4), added]) if known else added
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        self._checks.updateValue((number,), (every.tobytes(),))
        return [number, every[0, 2], every[-1, 2], _drops(every[:, 2]), len(every), int(every[:, 3].sum())]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        warned = frame["warn"].fillna(False).astype("int64")
        added = np.stack([frame["ts"], frame["seq"], frame["tok"], warned], axis=1).astype(np.int64)
        small = self._small.exists()
        if small or not self._index.exists():
            added = np.concatenate([_numbers(self._small.get()[0], 4), added]) if small else added
            if len(added) <= self._limit:
                every = added[np.lexsort((added[:, 1], added[:, 0]))]
                self._small.update((every.tobytes(),))
                yield self._activity(key, len(every), every[:, 3].sum(), _drops(every[:, 2]))
                return
            if small:
                self._small.clear()
        numbers = added[:, 0] // self._bucket_ms
        index = _numbers(self._index.get()[0], 6) if self._index.exists() else np.zeros((0, 6), np.int64)
        touched = np.unique(numbers)
        opened = [self._bucket(int(number), added[numbers == number]) for number in touched]
        index = np.concatenate([index[~np.isin(index[:, 0], touched)], np.array(opened, np.int64)])
        index = index[np.argsort(index[:, 0])]
        self._index.update((index.tobytes(),))
        between = int(np.maximum(index[:-1, 2] - index[1:, 1], 0).sum())
        yield self._activity(key, index[:, 4].sum(), index[:, 5].sum(), index[:, 3].sum() + between)

    @staticmethod
    def _activity(key, count, warned, reduction) -> pd.DataFrame:
        activity = pd.DataFrame({
            "sid": [key[0]], "check_count": [int(count)], "warn_count": [int(warned)], "reduction": [int(reduction)],
        })
        return plain_strings(activity, "sid")

    def close(self) -> None:
        pass


def activity_stream(ledger: DataFrame, bucket_ms: int = BUCKET_MS, small: int = SMALL_CHECKS) -> DataFrame:
    """Stream of ledger rows (with ``seq``) -> a session's activity so far, whenever it has new checks."""
    rows = measured_checks(ledger).select("sid", "ts", "seq", "tok", "warn")
    return rows.groupBy("sid").transformWithStateInPandas(
        statefulProcessor=ActivityProcessor(bucket_ms, small), outputStructType=_ACTIVITY, outputMode="Append", timeMode="None"
    )


def impact_streams(
    ledger: DataFrame, path: str, bucket_ms: int = BUCKET_MS, small: int = SMALL_CHECKS, **trigger
) -> list[StreamingQuery]:
    """Start the three streams; each writes what a trigger changed, or its totals, under ``batch_id=N``.

    A batch that is run again replaces its folder by the same rows.  All three see the same batches if the
    source decides what a batch is, as files with ``maxFilesPerTrigger`` do.
    """

    def start(rows: DataFrame, name: str, mode: str) -> StreamingQuery:
        def run(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")

        return (
            rows.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", f"{path}/checkpoints/{name}")
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    counts = checks(ledger).agg(F.count(F.lit(1)).alias("check_count"), F.count_if("warn").alias("warn_count"))
    return [
        start(activity_stream(ledger, bucket_ms, small), "activity", "append"),
        start(counts, "checks", "complete"),
        start(model_savings(ledger), "models", "complete"),
    ]


def _written(spark: SparkSession, path: str, name: str, batch_id: int) -> DataFrame:
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/batch_id=*")
    return rows.filter(F.col("batch_id") <= batch_id)


def activity_as_of(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Activity per session after a batch, as ``session_activity`` gives it for the ledger up to there."""
    last = F.max_by(F.struct("check_count", "warn_count", "reduction"), "batch_id").alias("last")
    return _written(spark, path, "activity", batch_id).groupBy("sid").agg(last).select("sid", "last.*")


def savings_as_of(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Savings by model family after a batch, as ``savings_by_family`` gives them."""
    return family_savings(_written(spark, path, "models", batch_id).filter(F.col("batch_id") == batch_id).drop("batch_id"))


def hook_activity_as_of(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """check_count, session_count, warn_count after a batch, as ``hook_activity`` gives them."""
    sessions = activity_as_of(spark, path, batch_id).agg(F.count(F.lit(1)).alias("session_count"))
    counts = _written(spark, path, "checks", batch_id).filter(F.col("batch_id") == batch_id)
    return counts.join(F.broadcast(sessions), how="cross").select("check_count", "session_count", "warn_count")
