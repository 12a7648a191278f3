"""Quality filtering by importance resampling.

Method: two generative models of hashed n-grams, one of target text (labelled good) and one of all
raw text; the log ratio of a document under them is its importance weight, and a Gumbel top-k draw
takes a sample without replacement in proportion to the weights.

The ratio is taken for words and for word pairs, smoothed and with its clipped negative parts, so a
few telltale words count in a long text.  A logistic fit on held-out labelled documents combines
these averages into one log weight.  The draw's size is the number of documents whose weight is on
the good side of the cut that separates the held-out documents best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from context_shaper.llm.tokens import by_bytes, mix, small_batches, token_hashes, words_and_marks
from context_shaper.session import stage

BUCKETS = 1 << 18
BLOCK = 1 << 13
SMOOTHING = 5.0
MARGINS = (None, 0.25, 1.0)
FEATURES = [f"f{i}" for i in range(4 * len(MARGINS))]
TABLES = 4  # words and pairs, each in target and raw text


@dataclass(frozen=True)
class Resampling:
    """``max_labels`` bounds the labelled rows that the models are fitted on; half of them train
    the target model, half the weights.  ``sharpness`` scales log weights against the Gumbel noise."""

    max_labels: int = 20_000
    sharpness: float = 12.0
    seed: int = 7


def _ngrams(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every word and of every pair of neighbouring words of one row."""
    hashes, offsets = token_hashes(column, words_and_marks())
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    mask = np.uint64(BUCKETS - 1)
    pairs = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    inside = rows[1:] == rows[:-1]
    return [((hashes & mask).astype(np.int64), rows), ((pairs[inside] & mask).astype(np.int64), rows[1:][inside])]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's n-gram counts, in blocks; rows are (text, is_target)."""
    counts = np.zeros((TABLES, BUCKETS), np.int64)
    for whole in batches:
        for batch in by_bytes(whole, 0):
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for kind, (bucket, row) in enumerate(_ngrams(batch.column(0))):
                counts[2 * kind] += np.bincount(bucket[target[row]], minlength=BUCKETS)
                counts[2 * kind + 1] += np.bincount(bucket, minlength=BUCKETS)
    blocks = counts.reshape(-1, BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    if len(used):
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([blocks[b].tobytes() for b in used], pa.binary())],
            names=["block", "counts"],
        )


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK, np.int64)
    for batch in batches:
        for block in batch.column("counts"):
            total += np.frombuffer(block.as_buffer(), np.int64)
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "counts": [total.tobytes()]})


def _models(texts: DataFrame) -> np.ndarray:
    """N-gram counts of target and raw text: tables of fixed size over all documents."""
    blocks = texts.mapInArrow(_count, "block int, counts binary").groupBy("block").applyInArrow(
        _add, "block int, counts binary"
    )
    counts = np.zeros((TABLES * BUCKETS // BLOCK, BLOCK), np.int64)
    for row in blocks.toLocalIterator():
        counts[row.block] = np.frombuffer(row.counts, np.int64)
    return counts.reshape(TABLES, BUCKETS)


def _log_ratios(counts: np.ndarray) -> np.ndarray:
    """Per kind of n-gram the smoothed log ratio of target to raw text, by bucket."""
    ratios = []
    for target, raw in (counts[0:2], counts[2:4]):
        share = target.sum() / max(raw.sum(), 1)
        ratios.append(np.log((target + SMOOTHING) / (raw * share + SMOOTHING)))
    return np.stack(ratios).astype(np.float32)


def _measure(ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 2):
                count, features, tokens = batch.num_rows, [], None
                for kind, (bucket, row) in enumerate(_ngrams(batch.column(2))):
                    size = np.bincount(row, minlength=count)
                    tokens = size if tokens is None else tokens
                    weight = ratios.value[kind][bucket].astype(np.float64)
                    for margin in MARGINS:
                        part = weight if margin is None else np.minimum(weight + margin, 0.0)
                        total = np.bincount(row, weights=part, minlength=count)
                        features += [total / np.maximum(size, 1), total / np.sqrt(np.maximum(size, 1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(tokens), *[pa.array(f) for f in features]],
                    names=["doc_id", "version", "n_tokens", *FEATURES],
                )

    return run


def _fit(features: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean and spread of the features, logistic weights (intercept first), and the best cut."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    inputs = np.column_stack([np.ones(len(features)), np.clip((features - mean) / spread, -6, 6)])
    weights, ridge = np.zeros(inputs.shape[1]), 0.1
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ (good - chance) - ridge * weights
        bend = (inputs * (chance * (1 - chance))[:, None]).T @ inputs + ridge * np.eye(len(weights))
        weights += np.linalg.solve(bend, slope)
    value = inputs @ weights
    order = np.argsort(value)
    lost = np.concatenate([[0], np.cumsum(good[order])]) / good.sum()
    left = 1 - np.concatenate([[0], np.cumsum(1 - good[order])]) / (1 - good).sum()
    best = int(np.argmin(2 * lost + left))  # losing good text counts twice
    value = value[order]
    cut = value[0] - 1 if best == 0 else value[-1] + 1 if best == len(value) else (value[best - 1] + value[best]) / 2
    return mean, spread, weights, float(cut)


def _log_weight(mean, spread, weights, cut) -> Column:
    total = F.lit(float(weights[0]) - cut)
    for name, m, s, w in zip(FEATURES, mean, spread, weights[1:]):
        scaled = (F.col(name) - float(m)) / float(s)
        total = total + F.least(F.greatest(scaled, F.lit(-6.0)), F.lit(6.0)) * float(w)
    return total


def kth_largest(scores: DataFrame, k: int, cells: int = 4096) -> float | None:
    """The k-th largest of scores(score); None if k is 0.  Each round counts ``cells`` intervals."""
    bounds = scores.agg(F.min("score"), F.max("score"), F.count("score")).first()
    low, high, total = bounds
    if k <= 0 or not total:
        return None
    rank = min(k, total)
    while low < high:
        step = (high - low) / cells
        if step == 0 or low + step == low:
            break
        cell = F.least(F.floor((F.col("score") - low) / step), F.lit(cells - 1)).alias("cell")
        counted = scores.filter(F.col("score").between(low, high)).groupBy(cell).agg(
            F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")
        ).collect()  # at most ``cells`` rows
        for row in sorted(counted, key=lambda r: -r.cell):
            if rank <= row.n:
                low, high = row.low, row.high
                break
            rank -= row.n
    return high


def judged_labels(labels: DataFrame, options: Resampling) -> DataFrame:
    """A bounded sample of (doc_id, good, train): good is quality 1 and not toxic."""
    judged = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")
    ).agg((F.min(F.coalesce("quality", F.lit(1))) >= 1).alias("q"), (F.max(F.coalesce("toxic", F.lit(0))) >= 1).alias("t"))
    draw = F.xxhash64("doc_id", F.lit(options.seed))
    return judged.select(
        "doc_id", (F.col("q") & ~F.col("t")).alias("good"), (draw % 2 == 0).alias("train"), draw.alias("draw")
    ).orderBy("draw", "doc_id").limit(options.max_labels).drop("draw")


def resample(documents: DataFrame, labels: DataFrame, options: Resampling = Resampling()) -> DataFrame:
    """(doc_id, version, n_tokens, log_weight, score, kept) for every row of documents(doc_id, text, ...).

    ``labels`` has doc_id, quality and toxic.  ``kept`` marks the Gumbel top-k sample; ``log_weight``
    is positive on the good side of the fitted cut.  ``version`` is a hash of the text.  Rows with the
    same doc_id and text get the same score and share their fate, so ties at the k-th score are all
    kept.  Null, empty and blank texts have no n-grams, no weight, and are never kept.  If the
    labelled sample lacks good or bad documents in either half, nothing can be fitted: every document
    with n-grams then has weight 0 and is kept.  An empty table gives an empty result.
    """
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most max_labels rows, so sending them to every task is bounded.
    sample = F.broadcast(stage(judged_labels(labels, options), "labels"))
    target = sample.filter("good AND train").select("doc_id", F.lit(True).alias("target"))
    counts = _models(
        texts.join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    )
    ratios = spark.sparkContext.broadcast(_log_ratios(counts))
    columns = ", ".join(f"{name} double" for name in FEATURES)
    measured = stage(
        texts.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(
            _measure(ratios), f"doc_id bigint, version bigint, n_tokens bigint, {columns}"
        ), "features",
    )
    held_out = measured.filter("n_tokens > 0").join(F.broadcast(sample.filter("NOT train")), "doc_id").dropDuplicates(["doc_id"])
    rows = held_out.select("good", *FEATURES).toPandas()  # at most max_labels rows
    good = rows["good"].to_numpy(dtype=float)
    weight = F.lit(0.0)
    if counts[0].sum() and 0 < good.sum() < len(good):
        weight = _log_weight(*_fit(rows[FEATURES].to_numpy(dtype=float), good))
    uniform = (F.abs(F.xxhash64("doc_id", "version", F.lit(options.seed)) % (1 << 40)) + 0.5) / float(1 << 40)
    scored = stage(
        measured.select(
            "doc_id", "version", "n_tokens", F.when(F.col("n_tokens") > 0, weight).alias("log_weight"), uniform.alias("u")
        ).select(
            "doc_id", "version", "n_tokens", "log_weight",
            (F.col("log_weight") * options.sharpness - F.log(-F.log("u"))).alias("score"),
        ), "scores",
    )
    drawn = scored.filter("log_weight >= 0").count()
    least = kth_largest(scored.select("score"), drawn)
    kept = F.lit(False) if least is None else F.coalesce(F.col("score") >= least, F.lit(False))
    return scored.withColumn("kept", kept)


def keep_good(documents: DataFrame, labels: DataFrame, options: Resampling = Resampling()) -> DataFrame:
    """The rows of documents that the draw keeps, with all their columns."""
    kept = resample(documents, labels, options).filter("kept").select("doc_id", "version").distinct()
    same = documents["doc_id"].cast("bigint").eqNullSafe(kept["doc_id"])
    return documents.join(kept, same & (F.xxhash64(documents["text"].cast("string")) == kept["version"]), "left_semi")
