"""Removal of lines that repeat, exactly or but for one word, an earlier line of the corpus.

Method: deletion-neighbourhood join.  A line emits hashed keys of itself and of every variant with
one word deleted.  Two lines are one edit apart exactly when a line equals a variant of the other
(a word inserted), or when their variants at the same place are equal (a word replaced), so grouping
the keys finds for every line its earliest neighbour without listing pairs.  The words of each line
and its neighbour are then compared.

Equal lines are one class from the start, and only classes that share a half of their words with
another class emit variants: of two lines one edit apart, one half or the other is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from context_shaper.llm.marks import marked_rows, marks_of
from context_shaper.llm.tokens import (
    by_bytes, mix, power, small_batches, span_hashes, space_separated, text_bytes, token_bounds,
)
from context_shaper.session import stage

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALT = np.uint64(0x3C79AC492BA7B653)


@dataclass(frozen=True)
class LineDedup:
    """Lines of fewer than ``min_words`` words are always kept; one edited word is allowed in lines
    of ``near_words`` words and more (``max_edits`` 0: only equal lines count)."""

    min_words: int = 5
    near_words: int = 10
    max_edits: int = 1


class _Lines:
    """The lines of a batch of texts, as runs of word hashes with running sums."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        self.count = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        starts, ends = token_bounds(data, offsets, space_separated()) if len(data) else (np.zeros(0, np.int64),) * 2
        words = span_hashes(data, starts, ends)
        row = np.searchsorted(offsets, starts, "right") - 1
        before = np.searchsorted(breaks, starts)  # line breaks before each word
        line = before - np.searchsorted(breaks, offsets[:-1])[row] if len(starts) else before
        new = np.ones(len(starts), bool)
        new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(starts)) if len(self.first) else self.first
        self.row, self.line = row[self.first], line[self.first]
        self.words = self.last - self.first
        self.sums = [_running(words), _running(mix(words ^ _SALT))]

    def spans(self, which: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        sums = self.sums[which]
        return (sums[last] - sums[first]) * power(_INVERSE, len(sums))[first]


def _running(words: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power(_BASE, len(words) + 1)[: len(words)], out=sums[1:])
    return sums


def _named(value: np.ndarray, *tags) -> np.ndarray:
    for tag in tags:
        value = mix(value + np.asarray(tag).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))
    return value


def _signed(value: np.ndarray) -> pa.Array:
    return pa.array(value.view(np.int64))


def _identities(lines: _Lines, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last, size = lines.first[chosen], lines.last[chosen], lines.words[chosen]
    return _named(lines.spans(0, first, last), size), _named(lines.spans(1, first, last), size)


def _describe(options: LineDedup):
    """One row per line: place, number of words, identity, and keys of its halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 2)):
            lines = _Lines(batch.column(2))
            chosen = np.flatnonzero(lines.words >= options.min_words)
            h1, h2 = _identities(lines, chosen)
            near = lines.words[chosen] >= options.near_words if options.max_edits else np.zeros(len(chosen), bool)
            at = chosen[near]
            first, last, size = lines.first[at], lines.last[at], lines.words[at]
            keys = []
            for smaller in (size, size - 1):  # the length of the shorter line of a pair
                head = smaller // 2
                tail = smaller - head
                keys.append(_named(lines.spans(0, first, first + head), smaller, 1))
                keys.append(_named(lines.spans(0, last - tail, last), smaller, 2))
            table = np.stack(keys, axis=1) if len(at) else np.zeros((0, 4), np.uint64)
            sizes = np.where(near, 4, 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            places = pa.array(lines.row[chosen])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(places), batch.column(1).take(places),
                 pa.array(lines.line[chosen].astype(np.int32)), pa.array(lines.words[chosen].astype(np.int32)),
                 _signed(h1), _signed(h2),
                 pa.ListArray.from_arrays(pa.array(offsets), _signed(table.reshape(-1)))],
                names=["doc_id", "version", "line", "words", "h1", "h2", "halves"],
            )

    return run


def _vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The variants of the wanted lines of rows (text, lines, ranks): the place of the deleted word
    (-1 for the line itself, with its text) and a key of what is left."""
    for whole in batches:
        for batch in by_bytes(whole, 0):
            lines = _Lines(batch.column(0))
            rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            wanted = rows * (1 << 32) + batch.column(1).flatten().to_numpy()
            order = np.argsort(wanted, kind="stable")
            places = lines.row * (1 << 32) + lines.line
            at = np.flatnonzero(np.isin(places, wanted))
            rank = batch.column(2).flatten().to_numpy()[order][np.searchsorted(wanted[order], places[at])]
            first, last, size = lines.first[at], lines.last[at], lines.words[at]
            gaps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            begin, end, count = (np.repeat(x, size) for x in (first, last, size))
            sums, back = lines.sums[0], power(_INVERSE, len(lines.sums[0]))
            each = begin + gaps
            rest = (sums[each] - sums[begin] + (sums[end] - sums[each + 1]) * np.uint64(_INVERSE)) * back[begin]
            yield _variants(np.repeat(rank, size), gaps, _named(rest, count - 1), pa.nulls(len(gaps), pa.string()))
            texts = [batch.column(0)[int(lines.row[i])].as_py().split("\n")[lines.line[i]] for i in at]
            itself = _named(lines.spans(0, first, last), size)
            yield _variants(rank, np.full(len(at), -1), itself, pa.array(texts, pa.string()))


def _variants(rank: np.ndarray, gaps: np.ndarray, keys: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rank, pa.int64()), pa.array(gaps.astype(np.int32)), _signed(keys), texts],
        names=["rank", "gap", "key", "text"],
    )


def one_edit(left: str, right: str) -> bool:
    """Whether two lines differ by at most one inserted, deleted or replaced word."""
    a, b = _plain_words(left), _plain_words(right)
    if abs(len(a) - len(b)) > 1:
        return False
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    if len(a) == len(b):
        return a[same + 1 :] == b[same + 1 :]
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return longer[same + 1 :] == shorter[same:]


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def _plain_words(text: str) -> list[str]:
    return [word for word in text.translate(_LOWER).translate(_SPACES).split(" ") if word]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        yield batch.select([0]).filter(pa.array([one_edit(a, b) for a, b in pairs], pa.bool_()))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, drops): the text without its dropped lines, and how many there were and went."""
    for batch in batches:
        texts, drops = batch.column(1).to_pylist(), batch.column(2)
        out, total, gone = [], [], []
        for at, text in enumerate(texts):
            numbers = set(drops[at].as_py() or ())
            lines = text.split("\n") if text is not None else []
            total.append(len(lines))
            gone.append(len(numbers))
            out.append("\n".join(x for i, x in enumerate(lines) if i not in numbers) if numbers else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, batch.column(1).type), drops, pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
            names=["row", "text", "drops", "n_lines", "n_dropped"],
        )


def _drops_near(lines: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, version, line) of first lines of classes that are one edit from an earlier line."""
    # One shuffle by half serves both the comparison and the join with it.
    halves = lines.select("h1", "h2", F.explode("halves").alias("half")).repartition("half")
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high")
    near = halves.join(shared.select("half"), "half", "left_semi").select("h1", "h2").distinct()
    # Sorted by place and numbered in that order, a line is named by one number that says which is earlier.
    near = classes.join(near, ["h1", "h2"]).select("place").orderBy("place")
    near = stage(near.select("place.*", F.monotonically_increasing_id().alias("rank")), "near-lines")
    wanted = near.groupBy("doc_id", "version").agg(F.collect_list(F.struct("line", "rank")).alias("wanted"))
    wanted = stage(wanted.select("doc_id", "version", "wanted.line", "wanted.rank"), "wanted")
    marks = texts.sparkSession.sparkContext.broadcast(marks_of(wanted.filter("doc_id IS NOT NULL").select("doc_id")))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(marked_rows(marks.value, batch.column(0)))

    texts = texts.filter("text IS NOT NULL").mapInArrow(maybe, texts.schema)
    same = (texts["doc_id"].eqNullSafe(wanted["doc_id"])) & (texts["version"] == wanted["version"])
    varied = stage(
        texts.join(wanted, same).select("text", "line", "rank")
        .mapInArrow(_vary, "rank bigint, gap int, key bigint, text string"), "variants",
    )
    # One shuffle by key: equal gaps of a key are replacements of one word, a line and a variant an insertion.
    by_gap, by_key = Window.partitionBy("key", "gap"), Window.partitionBy("key")
    met = varied.select("key", "gap", "rank").repartition("key").select(
        "rank", "gap", F.min("rank").over(by_gap).alias("replaced"),
        F.min(F.when(F.col("gap") < 0, F.col("rank"))).over(by_key).alias("whole"),
        F.min(F.when(F.col("gap") >= 0, F.col("rank"))).over(by_key).alias("variant"),
    )
    other = F.when(F.col("gap") < 0, F.col("variant")).otherwise(F.least("replaced", "whole"))
    earliest = met.select("rank", other.alias("other")).filter("other < rank").groupBy("rank").agg(
        F.min("other").alias("other")
    )
    said = varied.filter("gap < 0").select("rank", "text").dropDuplicates(["rank"])
    verified = (
        earliest.join(said, "rank").withColumnRenamed("text", "a")
        .join(said.select(F.col("rank").alias("other"), F.col("text").alias("b")), "other")
        .select("rank", "a", "b").mapInArrow(_verify, "rank bigint")
    )
    return near.join(verified, "rank").select("doc_id", "version", "line")


def _place(doc_id: str, version: str, line: str):
    """Document order: by doc_id (rows without one last), then by text, then by line."""
    return F.struct(
        F.col(doc_id).isNull().alias("late"), F.col(doc_id).alias("doc_id"), F.col(version).alias("version"),
        F.col(line).alias("line"),
    )


def line_dedup(documents: DataFrame, options: LineDedup = LineDedup()) -> DataFrame:
    """The rows of documents(doc_id, text, ...) with repeated lines taken out of ``text``, plus
    ``n_lines`` and ``n_dropped``.

    A line is what line feeds separate; its words are what the ASCII spaces separate, with A-Z
    lower-cased.  A line is dropped exactly when an earlier line of the corpus is at most one word
    edit away, whether or not that one is dropped itself.  Earlier means a smaller doc_id (rows
    without one come last), then a smaller hash of the text, then a smaller line number.  Rows that
    agree in doc_id and text are one document and lose the same lines.  Null and empty texts stay as
    they are; an empty table gives an empty result.  Other columns are carried along unchanged, save
    that columns named n_lines or n_dropped are replaced.
    """
    if options.max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    small_batches(documents.sparkSession)
    # The rest of the row travels as one value, so no column of the caller's can clash with one of ours.
    names = [name for name in documents.columns if name.lower() not in ("n_lines", "n_dropped")]
    others = [F.col(f"`{name}`") for name in names if name.lower() != "text"]
    keyed = documents.select(
        F.struct(*others).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("version"), F.col("text").cast("string").alias("text"),
    )
    texts = keyed.select("doc_id", "version", "text")
    lines = stage(
        texts.filter("text IS NOT NULL").mapInArrow(
            _describe(options),
            "doc_id bigint, version bigint, line int, words int, h1 bigint, h2 bigint, halves array<bigint>",
        ), "lines",
    )
    place = _place("doc_id", "version", "line")
    classes = stage(
        lines.groupBy("h1", "h2").agg(
            F.min(place).alias("place"), F.max(place).alias("last")
        ), "line-classes",
    )
    again = classes.filter("place < last").select("h1", "h2", "place")
    drops = lines.join(again, ["h1", "h2"]).filter(place > F.col("place")).select("doc_id", "version", "line")
    if options.max_edits:
        drops = drops.union(_drops_near(lines, classes, texts))
    by_document = drops.groupBy("doc_id", "version").agg(F.collect_set("line").alias("drops"))
    same = keyed["doc_id"].eqNullSafe(by_document["doc_id"]) & (keyed["version"] == by_document["version"])
    joined = keyed.join(by_document, same, "left").select("row", "text", "drops")
    schema = StructType([*joined.schema.fields]).add("n_lines", "long").add("n_dropped", "long")
    done = joined.mapInArrow(_rewrite, schema)
    return done.select(
        *[F.col("text") if name.lower() == "text" else F.col(f"row.`{name}`") for name in names], "n_lines", "n_dropped"
    )
