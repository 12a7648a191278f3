"""Finding benchmark passages in documents by winnowing, with built-in functions only.

Method: a text's fingerprints are the least hashes of its k-grams in every window of w neighbouring
k-grams, one per run of equal ones.  A span of w + k - 1 words has the same least hash wherever it
occurs, so every shared span of that length shares a fingerprint.  Documents and benchmark windows
meet on fingerprints, and a meeting is extended to the whole window by comparing hashes of all of
its words.  Texts are read once and never shuffled: a document sends out fingerprints only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from context_shaper.llm.native import ascii_lower, doc_key, let
from context_shaper.session import stage

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Winnowing:
    """``span``: words of a benchmark window (a shorter item is one window); ``gram``: words of a
    k-gram, at least half of the span."""

    span: int = 10
    gram: int = 5

    def __post_init__(self):
        if not self.gram <= self.span <= 2 * self.gram:
            raise ValueError("span must be between gram and twice gram")


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and characters beyond ASCII; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BREAK), "")


def _grams(tokens: Column, size: int) -> Column:
    """A hash of every run of ``size`` words; there must be one."""
    return F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (size - 1)), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(size)))
    )


def _wholes(grams: Column, gap: int) -> Column:
    """A hash of every run of words that a k-gram and the one ``gap`` words later cover."""
    return F.transform(
        F.sequence(F.lit(0), F.size(grams) - (gap + 1)),
        lambda i: F.xxhash64(F.get(grams, i), F.get(grams, i + gap)),
    )


def _least(grams: Column, width: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.size(grams) - (width - 1)), lambda i: F.array_min(F.slice(grams, i, F.lit(width)))
    )


def _fingerprints(tokens: Column, length: int, gram: int) -> Column:
    """Runs of equal least hashes: (key, at, wholes), with the hashes of the windows in the run."""
    size = min(gram, length)
    gap = length - size

    def runs(least: Column, wholes: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(least) - 1), lambda j: (j == 0) | (F.get(least, j) != F.get(least, j - 1))
        )
        return let(starts, lambda s: F.transform(s, lambda j, i: F.struct(
            F.xxhash64(F.get(least, j), F.lit(length)).alias("key"),
            j.alias("at"),
            F.slice(wholes, j + 1, F.coalesce(F.get(s, i + 1), F.size(least)) - j).alias("wholes"),
        )))

    found = let(_grams(tokens, size), lambda g: let(
        _least(g, gap + 1), lambda least: let(_wholes(g, gap), lambda wholes: runs(least, wholes))
    ))
    none = F.array().cast("array<struct<key:bigint,at:int,wholes:array<bigint>>>")
    return F.when(F.size(tokens) >= length, found).otherwise(none)


def benchmark_windows(benchmark: DataFrame, options: Winnowing = Winnowing()) -> DataFrame:
    """(key, whole, length, item_id) of every window of every item, equal windows of an item once."""
    items = benchmark.select(F.col("item_id"), words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    lengths = F.least(F.size("w"), F.lit(options.span))
    windows = items.withColumn("length", lengths).select(
        "item_id", "length", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: F.slice("w", i, F.col("length"))
        )).alias("w"),
    )
    parts = F.lit(None).cast("array<struct<key:bigint,at:int,wholes:array<bigint>>>")
    for length in range(1, options.span + 1):
        parts = F.when(F.col("length") == length, _fingerprints(F.col("w"), length, options.gram)).otherwise(parts)
    return windows.select("item_id", "length", F.get(parts, F.lit(0)).alias("f")).select(
        F.col("f.key").alias("key"), F.get("f.wholes", F.lit(0)).alias("whole"), "length", "item_id"
    ).distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, options: Winnowing = Winnowing()) -> DataFrame:
    """(doc_id, version, n_words, n_hit, n_items, items_sha256, contaminated), a row per row of documents.

    A document word is hit when it lies in any occurrence of a benchmark window.  Windows count as
    equal when two 64-bit hashes of their words agree.  Null, empty and wordless texts have no words,
    null, empty and wordless items no windows; an item without item_id taints but is not listed.
    Rows with the same doc_id and text get the same result, each its own row.  Other columns are
    ignored; with empty documents the result is empty, with an empty benchmark nothing is hit.
    """
    windows = stage(benchmark_windows(benchmark, options), "windows")
    known = stage(windows.select("key", "whole", "length").distinct(), "fingerprints")
    lengths = [row.length for row in known.select("length").distinct().collect()]  # at most span values
    text = F.col("text").cast("string")
    tokens = documents.select(doc_key(F.col("doc_id"), text).alias("doc"), words(text).alias("w"))
    # The first entry stands for the document itself, with a key of its own.
    itself = F.array(F.struct(
        F.xxhash64("doc").alias("key"), (-1 - F.size("w")).alias("at"), F.array().cast("array<bigint>").alias("wholes")
    ))
    entries = F.concat(itself, *[_fingerprints(F.col("w"), length, options.gram) for length in sorted(lengths)])
    rows = tokens.select("doc", F.explode(entries).alias("e")).select("doc", "e.key", "e.at", "e.wholes")
    met = rows.join(known, (rows["key"] == known["key"]) & F.array_contains(rows["wholes"], known["whole"]), "left").drop(
        known["key"]
    ).filter("at < 0 OR whole IS NOT NULL")
    starts = F.filter(
        F.transform("wholes", lambda g, i: F.when(g == F.col("whole"), F.col("at") + i)), lambda s: s.isNotNull()
    )
    hits = F.transform(starts, lambda s: F.struct(s.alias("first"), (s + F.col("length")).alias("end")))
    documents_hit = met.groupBy("doc").agg(
        F.sum((F.col("at") < 0).cast("long")).alias("copies"),
        F.max(F.when(F.col("at") < 0, -1 - F.col("at"))).cast("long").alias("n_words"),
        F.collect_list(F.when(F.col("at") >= 0, hits)).alias("hits"),
        F.collect_set(F.when(F.col("at") >= 0, F.struct("key", "whole", "length"))).alias("windows"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.array_sort(F.flatten("hits")), zero,
        lambda s, x: F.struct(
            (s["covered"] + F.greatest(x["end"] - F.greatest(x["first"], s["end"]), F.lit(0))).alias("covered"),
            F.greatest(s["end"], x["end"]).alias("end"),
        ), lambda s: s["covered"],
    )
    documents_hit = documents_hit.select("doc", "copies", "n_words", covered.alias("n_hit"), "windows")
    per_document = stage(documents_hit, "documents-hit")
    items = (
        per_document.select("doc", F.explode("windows").alias("x")).select("doc", "x.*")
        .join(windows, ["key", "whole", "length"]).groupBy("doc").agg(F.collect_set("item_id").alias("items"))
    )
    listed = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    return (
        per_document.drop("windows").join(items, "doc", "left")
        .withColumn("listed", listed)
        .select(
            "doc.*", "n_words", "n_hit", F.size("listed").cast("long").alias("n_items"),
            F.sha2(F.array_join("listed", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        ).drop("copy")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, options: Winnowing = Winnowing()) -> DataFrame:
    """The rows of documents in which no benchmark window occurs, with all their columns."""
    tainted = contamination(documents, benchmark, options).filter("contaminated").select(
        F.struct("doc_id", "version").alias("tainted")
    ).distinct()
    own = doc_key(documents["doc_id"], documents["text"].cast("string"))
    return documents.join(tainted, own == tainted["tainted"], "left_anti")
