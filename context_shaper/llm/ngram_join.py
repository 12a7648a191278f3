"""Self-join of documents on the Jaccard similarity of their word n-grams.

Method: multiple-global-order filtering.  For a similarity of s, two sets of a and b elements can
only agree if, under *any* total order of all elements, their first ``a - ceil(s a) + 1`` (and
``b - ...``) elements meet.  The first order puts rare elements first and generates candidates;
two further, unrelated orders filter them; the exact similarity decides.

Equal sets are one class from the start.  Within the documents that share a prefix element, links
are found against chosen hubs first, and only pairs that are not yet in one component are looked at
afterwards, so a large group of near copies costs a number of pairs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from context_shaper.llm.graph import components
from context_shaper.llm.marks import marked_rows, marks_of
from context_shaper.llm.tokens import grams, list_column, mix, small_batches, space_separated, token_hashes
from context_shaper.session import stage

COUNT_BUCKETS = 1 << 18
COUNT_BLOCK = 1 << 12


@dataclass(frozen=True)
class NgramJoin:
    """``percent`` is the least similarity in percent; ``words`` the length of an n-gram."""

    words: int = 3
    percent: int = 90


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its n-grams; a shorter text is one element."""
    hashes, offsets = token_hashes(column, space_separated())
    runs = grams(hashes, words)
    sets = []
    for first, last in zip(offsets[:-1], offsets[1:]):
        if last - first >= words:
            sets.append(np.unique(runs[first : last - words + 1]))
        elif last > first:
            sets.append(grams(hashes[first:last], int(last - first)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _identities(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's elements: together they name the set."""
    first = np.fromiter((mix(s).sum(dtype=np.uint64) for s in sets), np.uint64, len(sets))
    salt = np.uint64(0xA5A5A5A5A5A5A5A5)
    second = np.fromiter((mix(s ^ salt).sum(dtype=np.uint64) for s in sets), np.uint64, len(sets))
    return _signed(first), _signed(second)


def _describe(words: int):
    """Size and identity of each row's set, then this task's element counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
            if sizes.sum():
                buckets = (np.concatenate(sets) & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)
                counts += np.bincount(buckets, minlength=COUNT_BUCKETS)
            first, second = _identities(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(first), pa.array(second),
                 pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "block", "counts"],
            )
        if counts.any():
            blocks = counts.reshape(-1, COUNT_BLOCK)
            number, empty = len(blocks), pa.nulls(len(blocks), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [empty, empty, empty, empty, pa.array(np.arange(number, dtype=np.int32)),
                 pa.array([b.tobytes() for b in blocks], pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "block", "counts"],
            )

    return run


def _add_blocks(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNT_BLOCK, np.int64)
    for batch in batches:
        for block in batch.column("counts"):
            total += np.frombuffer(block.as_buffer(), np.int64)
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "counts": [total.tobytes()]})


def element_counts(described: DataFrame) -> np.ndarray:
    """How often elements occur, by bucket: a table of fixed size, whatever the input's."""
    blocks = (
        described.filter("block IS NOT NULL").select("block", "counts")
        .groupBy("block").applyInArrow(_add_blocks, "block int, counts binary")
    )
    counts = np.zeros((COUNT_BUCKETS // COUNT_BLOCK, COUNT_BLOCK), np.int64)
    for row in blocks.toLocalIterator():
        counts[row.block] = np.frombuffer(row.counts, np.int64)
    return counts.reshape(-1)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1 if size else 0


def _prefixes(counts, options: NgramJoin):
    """Each row's leading elements: rare first, and under two unrelated orders."""
    mask = np.uint64(COUNT_BUCKETS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.minimum(counts.value, (1 << 32) - 1).astype(np.uint64) << np.uint64(32)
        for batch in batches:
            sets = shingle_sets(batch.column(1), options.words)
            rare, second, third = [], [], []
            for s in sets:
                length = prefix_length(len(s), options.percent)
                # The sets are sorted, so a stable sort breaks ties by element in every document.
                order = np.argsort(frequency[(s & mask).astype(np.int64)] | (s >> np.uint64(32)), kind="stable")
                rare.append(_signed(s[order[:length]]))
                for salt, size, into in ((0x5851F42D4C957F2D, 2 * length, second), (0x14057B7EF767814F, length, third)):
                    mixed = np.sort(mix(s ^ np.uint64(salt)))[:size]
                    into.append((mixed >> np.uint64(32)).astype(np.uint32).view(np.int32))
            first, _ = _identities(sets)
            sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first), pa.array(sizes), list_column(rare, pa.int64()),
                 list_column(second, pa.int32()), list_column(third, pa.int32())],
                names=["doc_id", "h1", "n", "rare", "second", "third"],
            )

    return run


def _whole_sets(words: int, wanted):
    """Sets of the documents whose bucket is marked as wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = wanted.value
        for batch in batches:
            batch = batch.filter(marked_rows(marks, batch.column(0)))
            sets = shingle_sets(batch.column(1), words)
            first, _ = _identities(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first), list_column([_signed(s) for s in sets], pa.int64())],
                names=["doc_id", "h1", "elements"],
            )

    return run


def _needed(n1: Column, n2: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes that reaches the similarity."""
    return F.ceil((n1 + n2) * percent / F.lit(100.0 + percent))


def _may_agree(a: str, b: str, percent: int) -> Column:
    """Length and position filters of a pair that meets in one element."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n1 - F.col(f"{a}.place"), n2 - F.col(f"{b}.place"))
    return (n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent) & (left >= _needed(n1, n2, percent))


def _pairs_with_hubs(shared: DataFrame, percent: int) -> DataFrame:
    """Every member of a group with two chosen members of it.

    The member whose common elements come first has the fewest of its own, so it is the likely
    original of near copies; the other one is chosen by hash.
    """
    hubs = shared.groupBy("element").agg(
        F.min(F.struct("place", "id", "n")).alias("first"),
        F.min(F.struct(F.xxhash64("id").alias("hash"), "id", "n", "place")).alias("any"),
    ).select("element", F.explode(F.array(*[
        F.struct(F.col(f"{hub}.id"), F.col(f"{hub}.n"), F.col(f"{hub}.place")) for hub in ("first", "any")
    ])).alias("hub"))
    return (
        shared.alias("m").join(hubs, "element").filter("hub.id <> m.id").filter(_may_agree("m", "hub", percent))
        .select(F.least("m.id", "hub.id").alias("u"), F.greatest("m.id", "hub.id").alias("v")).distinct()
    )


def _met_across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows(element, id, n, place, label) of one element as structs (a, b), a the larger one.

    A row at a place can be similar only to partners up to a certain size.  So it stands as the
    smaller one of pairs only if that size is not below its own, and as the larger one it looks only
    into the bands of sizes that it allows, two at most.  Texts of a template, whose common element
    comes too late in all of them, meet nobody.
    """
    def band(size: Column) -> Column:
        return size if percent >= 100 else F.floor(F.log(size.cast("double")) / float(np.log(100 / percent)))

    row = F.struct("id", "n", "place", "label")
    most = F.expr(f"((n - place) * {100 + percent} - n * {percent}) div {percent}")
    low, high = F.expr(f"(n * {percent} + 99) div 100"), F.least("n", most)
    smaller = rows.filter(most >= F.col("n")).select("element", band(F.col("n")).alias("band"), row.alias("b"))
    larger = rows.filter(high >= low).select("element", F.explode(F.sequence(band(low), band(high))).alias("band"), row.alias("a"))
    return larger.join(smaller, ["element", "band"])


def _pairs_across(shared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs that share an element, may agree by it and are not yet in one component."""
    rows = stage(shared.join(labels, "id"), "labelled")
    open_groups = rows.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(
        "low < high"
    ).select("element")
    rows = stage(rows.join(open_groups, "element", "left_semi"), "open-groups")
    return (
        _met_across(rows, percent).filter("a.label <> b.label AND (a.n > b.n OR a.n = b.n AND a.id < b.id)")
        .filter(_may_agree("a", "b", percent))
        .select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()
    )


def _pass_other_orders(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose leading elements also meet under the second and the third order.

    Of an overlap of c, the first ``a - c + l`` and ``b - c + l`` elements share at least l.  The
    second order keeps twice the needed length, so it asks for many common elements; elements are
    cut to 32 bits there, and what a document lost by that is allowed for.
    """
    sides = prefixes.select("id", "n", "second", "third")
    both = pairs.join(sides.toDF("u", "nu", "u2", "u3"), "u").join(sides.toDF("v", "nv", "v2", "v3"), "v")
    least = F.least(F.size("u2") - F.col("nu"), F.size("v2") - F.col("nv")) + _needed(F.col("nu"), F.col("nv"), percent)
    lost = F.size("u2") - F.size(F.array_distinct("u2")) + F.size("v2") - F.size(F.array_distinct("v2"))
    return both.filter(
        F.arrays_overlap("u3", "v3") & (F.size(F.array_intersect("u2", "v2")) + lost >= least)
    ).select("u", "v")


def _links(pairs: DataFrame, texts: DataFrame, options: NgramJoin) -> DataFrame:
    """The pairs that reach the similarity, by their whole sets."""
    ends = stage(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ends")
    wanted = texts.sparkSession.sparkContext.broadcast(marks_of(ends.select("id.doc_id")))
    sets = stage(
        texts.mapInArrow(_whole_sets(options.words, wanted), "doc_id bigint, h1 bigint, elements array<bigint>")
        .select(F.struct("doc_id", "h1").alias("id"), "elements").join(ends, "id", "left_semi")
        .dropDuplicates(["id"]), "sets",
    )
    both = F.size(F.array_intersect("eu", "ev"))
    return stage(
        pairs.join(sets.toDF("u", "eu"), "u").join(sets.toDF("v", "ev"), "v")
        .select("u", "v", both.alias("both"), (F.size("eu") + F.size("ev")).alias("sizes"))
        .filter(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * options.percent).select("u", "v"), "links",
    )


def _labels(ids: DataFrame, links: DataFrame) -> DataFrame:
    return stage(
        ids.join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("label")), "labels"
    )


def ngram_join(documents: DataFrame, options: NgramJoin = NgramJoin()) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of documents(doc_id, text, ...).

    Words are what the six ASCII spaces separate, with A-Z lower-cased; a text with fewer words than
    an n-gram has its whole word sequence as its only element, and one without words has none and is
    linked with nothing (null and empty texts).  ``component_id`` is the smallest doc_id that links
    reach.  Rows that share a doc_id count as linked, and each keeps the size of its own text.  Rows
    without a doc_id are compared with nothing and get no component.  Other columns are ignored.
    An empty table gives an empty result.
    """
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stage(
        texts.mapInArrow(
            _describe(options.words),
            "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, block int, counts binary",
        ), "described",
    )
    counts = spark.sparkContext.broadcast(element_counts(described))
    rows = described.filter("block IS NULL").select("doc_id", "n_shingles", "h1", "h2")
    # One class per set, named by its smallest doc_id together with a hash of the set.
    classes = stage(
        rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2")
        .agg(F.struct(F.min("doc_id").alias("doc_id"), "h1").alias("id")), "classes",
    )
    prefixes = stage(
        texts.filter("doc_id IS NOT NULL").mapInArrow(
            _prefixes(counts, options),
            "doc_id bigint, h1 bigint, n bigint, rare array<bigint>, second array<int>, third array<int>",
        )
        .select(F.struct("doc_id", "h1").alias("id"), "n", "rare", "second", "third")
        .join(classes.select("id"), "id", "left_semi").dropDuplicates(["id"]).select("*", "id.*"), "prefixes",
    )
    # One shuffle by element serves both the count and the join with it.
    leading = prefixes.select("doc_id", "h1", "n", F.posexplode("rare").alias("place", "element")).repartition("element")
    several = leading.groupBy("element").agg(F.count("*").alias("members")).filter("members > 1").select("element")
    shared = stage(
        leading.join(several, "element", "left_semi")
        .select(F.struct("doc_id", "h1").alias("id"), "n", "place", "element"), "shared",
    )

    repeated = classes.join(rows.select("doc_id", "h1", "h2").distinct(), ["h1", "h2"]).select("doc_id", "id")
    same_id = repeated.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("w")).filter("v < w")
    same_id = repeated.join(same_id, "doc_id").filter("id <> v").select(F.col("id").alias("u"), "v")

    pairs = stage(_pass_other_orders(_pairs_with_hubs(shared, options.percent), prefixes, options.percent), "pairs")
    links = stage(_links(pairs, texts, options).union(same_id), "links")
    labels = _labels(classes.select("id"), links)
    rest = _pairs_across(shared, labels, options.percent).join(pairs, ["u", "v"], "left_anti")
    rest = stage(_pass_other_orders(rest, prefixes, options.percent), "pairs")
    if not rest.isEmpty():
        labels = _labels(classes.select("id"), links.union(_links(rest, texts, options)))
    named = classes.join(labels, "id").select("h1", "h2", F.col("label.doc_id").alias("component"))
    return rows.join(named, ["h1", "h2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def one_of_each_group(documents: DataFrame, options: NgramJoin = NgramJoin()) -> DataFrame:
    """The rows of documents that stay when each component keeps its smallest doc_id only.

    Rows that share that doc_id all stay, and so do rows without a doc_id or without words.
    """
    dropped = stage(
        ngram_join(documents, options).filter("component_id <> doc_id").select("doc_id").distinct(),
        "duplicates",
    )
    return documents.join(dropped, documents["doc_id"].cast("bigint") == dropped["doc_id"], "left_anti")
