"""Scanning every historical version of every file for secrets, each content once.

Method: incremental blob ledger.  A version's content address is the SHA-256 of its text.  The
ledger remembers which (blob, rule, rule version) triples have been scanned and what was found; only
triples it lacks are scanned, one text per blob, and findings are joined back to all paths.  Addresses
are counted first: a text that occurs once is scanned where it is read, and only unseen texts that
occur several times are brought together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from context_shaper.llm.spans import spans
from context_shaper.session import stage

LEDGER = "blob string, rule string, rule_version int, spans array<struct<start:int,end:int>>"
_LISTS = 3  # the commonest lists of rules to scan, as told by two bits; 0 sends a text to the join
_BLOCK = 1 << 15  # bits of one of Spark's bitmaps
_PLACES = (1 << 23, 1 << 27)  # least and most places of the bitmaps: 2 MB and 32 MB with two bits each
_PLACES_A_BLOB = 16


@dataclass(frozen=True)
class Rule:
    """A pattern, how many characters of ``group`` a match needs, and a number that grows when either changes."""

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1


# The published patterns of the base kinds, in their order.  Possessive repeats keep
# the scan linear; nothing after them could make use of what they hold.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 2, 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]++", 0, 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),  # a whole run matches, or nothing of it
)


def _found(text: Column, rule: Rule) -> Column:
    def enough(match: Column) -> Column:
        part = match if not rule.group else F.regexp_extract(match, rule.pattern, rule.group)
        return F.length(part) >= rule.least

    return F.transform(
        spans(text, rule.pattern, enough), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    )


def content_address(text: Column) -> Column:
    """SHA-256 of a text; null is the empty text."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _is(rule: str, version: int) -> Column:
    return (F.col("rule") == rule) & (F.col("rule_version") == version)


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(name) for name in names]).cast("array<string>")


def _lacking(counted: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """blob, copies and ``todo``, the sorted names of the rules under which the ledger lacks the blob."""
    wanted = list(dict.fromkeys((rule.name, rule.version) for rule in rules))
    if ledger is None:
        return counted.withColumn("todo", _names(sorted({name for name, _ in wanted})))
    own = F.coalesce(*[F.when(_is(*pair), F.lit(i)) for i, pair in enumerate(wanted)])
    known = ledger.select("blob", own.alias("own")).filter("own IS NOT NULL").groupBy("blob").agg(F.collect_set("own").alias("known"))
    lacks = F.array_except(F.array(*[F.lit(i) for i in range(len(wanted))]), F.coalesce("known", F.array().cast("array<int>")))
    todo = F.array_sort(F.array_distinct(F.transform(lacks, lambda i: F.get(_names([name for name, _ in wanted]), i))))
    return counted.join(known, "blob", "left").select("blob", "copies", todo.alias("todo"))


def _place(places: int) -> tuple[Column, Column]:
    """Block and bit of a blob."""
    place = F.pmod(F.xxhash64("blob"), F.lit(places))
    return F.floor(place / _BLOCK).cast("int"), (place % _BLOCK).cast("int")


def _told_codes(work: DataFrame) -> tuple[Column, tuple[int, DataFrame]]:
    """Lists of rules, and for each place of a bitmap a code: 1 for the first list and so on.

    A code holds for all blobs of its place, so it is exact.  Places whose blobs differ, blobs of several
    copies to scan and those of rarer lists have code 0.
    """
    alone = (F.col("copies") == 1) | (F.size("todo") == 0)
    common = work.filter(alone).groupBy("todo").count().orderBy(F.desc("count"), "todo").limit(_LISTS)
    lists = [_names(row["todo"]) for row in common.collect()]
    least, most = _PLACES
    places = min(most, max(least, 1 << (_PLACES_A_BLOB * work.count()).bit_length()))
    code = F.coalesce(*[F.when(alone & (F.col("todo") == x), F.lit(i + 1)) for i, x in enumerate(lists)], F.lit(0))
    block, bit = _place(places)
    # A block is at most 32,768 places: one shuffle by block serves both groupings.
    each = work.select(block.alias("block"), bit.alias("bit"), code.alias("code")).repartition("block")
    same = each.groupBy("block", "bit").agg(F.min("code").alias("code"), F.max("code").alias("high")).filter("code = high AND code > 0")
    bits = [F.bitmap_construct_agg(F.when(F.getbit("code", F.lit(i)) == 1, F.col("bit").cast("long"))) for i in (0, 1)]
    told = same.groupBy("block").agg(bits[0].alias("low_bits"), bits[1].alias("high_bits"))
    return F.array(*lists).cast("array<array<string>>"), (places, told)


def _with_code(blobs: DataFrame, codes: tuple[int, DataFrame]) -> DataFrame:
    places, told = codes
    block, bit = _place(places)

    def at(bitmap: str) -> Column:
        byte = F.substring(F.col(bitmap), F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))
        return F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.col("bit") % 8).cast("int"), F.lit(0))

    placed = blobs.select("blob", "text", block.alias("block"), bit.alias("bit"))
    return placed.join(F.broadcast(told), "block", "left").select("blob", "text", (at("low_bits") + 2 * at("high_bits")).alias("code"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger rows (blob, rule, rule_version, spans) that versions(text, ...) adds to ``ledger``.

    Each row is one scan of one distinct text under one rule version, with or without findings.  The
    caller appends them to its ledger table.  Positions are code points, ends exclusive.  Null and
    empty texts are one blob without findings; other columns are ignored; an empty table, or one whose
    blobs have all been scanned under these rule versions, adds nothing.
    """
    blobs = versions.select(content_address(F.col("text")).alias("blob"), F.col("text").cast("string").alias("text"))
    work = stage(_lacking(blobs.groupBy("blob").agg(F.count("*").alias("copies")), ledger, rules), "unseen")
    lists, codes = _told_codes(work)
    rows = _with_code(blobs, codes)
    once = rows.filter("code > 0").withColumn("todo", F.get(lists, F.col("code") - 1)).filter(F.size("todo") > 0)
    several = rows.filter("code = 0").groupBy("blob").agg(F.first("text").alias("text")).join(
        work.filter(F.size("todo") > 0).select("blob", "todo"), "blob"
    )
    each = once.select("blob", "text", "todo").unionByName(several)
    text = F.coalesce("text", F.lit(""))
    scans = F.array(*[
        F.when(F.array_contains("todo", rule.name), F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("rule_version"), _found(text, rule).alias("spans")
        )) for rule in rules
    ])
    return each.select("blob", F.explode(scans).alias("s")).filter("s IS NOT NULL").select("blob", "s.*")


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of versions, without their text, with a column for each rule: an array of its (start, end).

    Only the ledger's rows of these rule versions count; a version whose blob the ledger lacks has
    no findings.  Columns of versions named like a rule are replaced.
    """
    current = None
    for rule in rules:
        own = _is(rule.name, rule.version)
        current = own if current is None else current | own
    found = ledger.filter(current).filter(F.size("spans") > 0).groupBy("blob").agg(*[
        F.max(F.when(F.col("rule") == rule.name, F.col("spans"))).alias(rule.name) for rule in rules
    ])
    none = F.array().cast("array<struct<start:int,end:int>>")
    names = {rule.name.lower() for rule in rules} | {"text"}
    kept = [name for name in versions.columns if name.lower() not in names]
    paths = versions.select(
        F.struct(*[F.col(f"`{name}`") for name in kept]).alias("row"), content_address(F.col("text")).alias("address")
    )
    return paths.join(found, paths["address"] == found["blob"], "left").select(
        *[F.col(f"row.`{name}`") for name in kept],
        *[F.coalesce(found[rule.name], none).alias(rule.name) for rule in rules],
    )


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES):
    """(findings per row of versions, ledger rows to append): one increment of the scan."""
    added = stage(update_ledger(versions, ledger, rules), "ledger")
    known = added if ledger is None else ledger.unionByName(added)
    return findings_by_path(versions, known, rules), added
