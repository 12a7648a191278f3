"""Importance resampling of documents towards a target distribution, by bit-sliced aggregation.

Method: a document is the counts of its hashed word runs in 10,000 buckets, cut into planes of one bit
per bucket (plane j holds bit j of every count).  Every bucket has a whole-number gain, its log ratio
of target to raw text; positive and negative gains are cut into planes likewise.  A document's weight,
the sum of count times gain, is the sum over pairs of planes of a power of two times the number of
bits that both have set.  The sums are whole numbers, so they are exact and do not depend on the order.

Texts are read twice, once for the counts of all text and once for the weights, and never shuffled.
What the driver and the tasks hold of the whole corpus are 10,000 counts and as many gains.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from context_shaper.llm.crc import run_crcs, span_crcs
from context_shaper.llm.tokens import by_bytes, text_bytes, token_bounds
from context_shaper.session import stage

ROWS = 64  # documents whose counts are sliced at once


@dataclass(frozen=True)
class BitSlices:
    """``runs``: longest run of words that counts as a feature; ``scale``: gains per unit of log ratio;
    of the documents with ``min_words`` and more, ``percent`` are drawn; ``seed`` begins the noise's key."""

    runs: int = 3
    buckets: int = 10_000
    scale: int = 1000
    min_words: int = 20
    percent: int = 5
    seed: int = 42


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _word_bytes() -> np.ndarray:
    """1 for digits, ASCII letters and all bytes of characters beyond ASCII."""
    classes = np.zeros(256, np.uint8)
    classes[48:58] = classes[65:91] = classes[97:123] = classes[128:] = 1
    return classes


_LOWER, _WORD = _lower(), _word_bytes()


def _features(column: pa.Array, options: BitSlices) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the row each is of, and the number of words per row."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    starts, ends = token_bounds(data, offsets, _WORD)
    words = np.diff(np.searchsorted(starts, offsets))
    row = np.repeat(np.arange(rows), words)
    buckets, owners = [], []
    for size, crcs in enumerate(run_crcs(span_crcs(_LOWER[data], starts, ends), ends - starts, options.runs)):
        inside = row[size:] == row[: len(row) - size]
        buckets.append((crcs % np.uint32(options.buckets))[inside].astype(np.int64))
        owners.append(row[size:][inside])
    return np.concatenate(buckets), np.concatenate(owners), words


def _count(options: BitSlices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(options.buckets, np.int64)
        for whole in batches:
            for batch in by_bytes(whole, 0):
                counts += np.bincount(_features(batch.column(0), options)[0], minlength=options.buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, options: BitSlices = BitSlices()) -> np.ndarray:
    """Features of all texts(text) per bucket: a row per bucket and task is shuffled, a row per bucket collected."""
    counted = texts.select("text").mapInArrow(_count(options), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(options.buckets, np.int64)
    for row in counted.collect():
        counts[row.bucket] = row.n
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray, options: BitSlices = BitSlices()) -> list[int]:
    """Per bucket the scaled log ratio of target to raw text, smoothed by one feature per bucket."""
    raw_total, target_total = int(raw.sum()) + options.buckets, int(target.sum()) + options.buckets
    return [
        math.floor(options.scale * math.log(float((t + 1) * raw_total) / float((s + 1) * target_total)))
        for s, t in zip(raw.tolist(), target.tolist())
    ]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def gain_planes(gains: list[int]) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) for each bit of the positive and of the negative gains."""
    planes = []
    for sign in (1, -1):
        size = np.maximum(sign * np.array(gains, np.int64), 0)
        for bit in range(int(size.max(initial=0)).bit_length()):
            planes.append((sign << bit, _packed(((size >> bit) & 1).astype(bool)[None, :])[0]))
    return planes


def plane_sums(counts: np.ndarray, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Per row of counts the sum of count times gain."""
    total, power = np.zeros(len(counts), np.int64), 1
    while counts.any():
        bits = _packed((counts & 1).astype(bool))
        for gain, plane in planes:
            total += gain * power * np.bitwise_count(bits & plane).sum(axis=1, dtype=np.int64)
        counts, power = counts >> 1, 2 * power
    return total


def _weigh(planes: list[tuple[int, np.ndarray]], options: BitSlices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                buckets, rows, words = _features(batch.column(1), options)
                order = np.argsort(rows, kind="stable")
                buckets, sizes = buckets[order], np.bincount(rows, minlength=batch.num_rows)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                weights = np.zeros(batch.num_rows, np.int64)
                for first in range(0, batch.num_rows, ROWS):
                    last = min(first + ROWS, batch.num_rows)
                    cell = buckets[ends[first] : ends[last]] + options.buckets * np.repeat(
                        np.arange(last - first), sizes[first:last]
                    )
                    counts = np.bincount(cell, minlength=(last - first) * options.buckets)
                    weights[first:last] = plane_sums(counts.reshape(-1, options.buckets), planes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(words.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(weights)],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return run


def _noise(options: BitSlices) -> Column:
    """Gumbel noise in units of the scale, from a hash of the doc_id; without one, of none."""
    key = F.concat(F.lit(f"{options.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * float(-options.scale))


def _ranked(rows: DataFrame, first: int) -> DataFrame:
    """``rank`` from 1 of the ``first`` rows with the highest scores, null for the others; ties to smaller
    doc_ids, missing ones last.  Rows are ranked inside ranges of scores and shifted by the ranges before."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    dealt = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before, places = 0, []
    for row in sorted(dealt.groupBy("part").count().collect()):  # a row per range
        places.append((row[0], before))
        before += row[1]
    offsets = rows.sparkSession.createDataFrame(places, "part int, before bigint")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = dealt.join(offsets, "part").withColumn("rank", rank).drop("part", "before")
    return ranked.withColumn("rank", F.when(F.col("rank") <= first, F.col("rank")).cast("bigint"))


def importance_weights(documents: DataFrame, target: DataFrame, options: BitSlices = BitSlices()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for every row of documents(doc_id, text, ...).

    ``target``(text, ...) holds texts of the wanted distribution.  Words are lower-case runs of letters,
    digits and characters beyond ASCII, features all runs of one to ``runs`` words.  Null, empty and
    wordless texts have no features and weight 0; with an empty target every gain follows from smoothing
    alone.  Long texts are taken whole, one at a time.  Other columns of either table are ignored, rows with
    the same doc_id and text give equal rows, and an empty table an empty result.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(texts, options), bucket_counts(
        target.select(F.col("text").cast("string").alias("text")), options
    ), options)
    measured = texts.mapInArrow(
        _weigh(gain_planes(gains), options), "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    )
    return measured.withColumn("score", F.col("weight") + _noise(options))


def resample_to_target(documents: DataFrame, target: DataFrame, options: BitSlices = BitSlices()) -> DataFrame:
    """``importance_weights`` with ``rank``: 1, 2, 3, ... for the documents drawn, null for the others.

    Adding Gumbel noise to the weights and taking the highest sums is a draw without replacement in
    proportion to the exponentials of the weights.  Ties go to the smaller doc_id, rows without one come last.
    """
    scored = stage(importance_weights(documents, target, options), "weights")
    able = F.col("n_words") >= options.min_words
    first = scored.filter(able).count() * options.percent // 100
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return _ranked(scored.filter(able), first).unionByName(rest)
