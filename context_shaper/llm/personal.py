"""Finding personal data: validated patterns first, then what stands where they stand.

Method: bootstrapped contextual extraction.  Validated addresses and numbers are seed instances.  The
words before an identifier-like token, or before a run of tokens that looks like one identifier, are
its lexical pattern.  Over the graph of patterns and instances rounds score each pattern by the share
of its distinct instances that are known, take the patterns of high confidence and support, and learn
their other instances, until no new pattern is accepted.  Candidates in accepted patterns, or learned
elsewhere, are reported whole with kind ``context``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from context_shaper.llm.native import ascii_lower, doc_key, let
from context_shaper.llm.spans import spans
from context_shaper.session import stage

# The published patterns of the base kinds, in their order.  A match begins at the end
# of the one before or where a run begins; within a run no later start could succeed.  Possessive
# repeats keep the scan linear.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"

SPACE = r"\x20\x09-\x0D"
# A run without spaces that holds a digit.
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"
# A run without spaces and digits that joins letters by a mark, as jane.doe or name(at)host.
_AT = r"[(\[{<][aA][tT][)\]}>]"
MARKED = (
    rf"(?<![^{SPACE}])(?=[^{SPACE}0-9]++(?![^{SPACE}]))"
    rf"[^{SPACE}]*?\p{{L}}(?:[._@+~#\\-]|{_AT})\p{{L}}[^{SPACE}]*+"
)
# Identifiers of several tokens: groups of digits, groups of four after a country and check digits, and
# addresses with a spelt-out sign.
_GAP = r"[\x20\t]"
_GROUP = r"[0-9][0-9()./+-]*+"
_DOT = rf"(?:{_GAP}(?i:dot|[(\[{{<]dot[)\]}}>]){_GAP}[^{SPACE}]++)"
RUN = (
    rf"(?<![^{SPACE}])(?:"
    rf"[^{SPACE}A-Za-z0-9]*+{_GROUP}(?:{_GAP}++(?:[/.-]{_GAP}++)?+[(+]*+{_GROUP}(?![^{SPACE},;:!?\"'\])}}>]))++"
    rf"|[^{SPACE}A-Za-z0-9]*+[A-Z]{{2}}[0-9]{{2}}(?:{_GAP}[A-Z0-9]{{4}}(?![A-Za-z0-9])){{2,}}+(?:{_GAP}[0-9]{{1,3}}(?![A-Za-z0-9]))?+"
    rf"|[^{SPACE}]++(?:(?:{_GAP}{_AT}{_GAP}?+|(?<={_AT}){_GAP})[^{SPACE}]++{_DOT}*+|{_GAP}[aA][tT]{_GAP}[^{SPACE}]++{_DOT}++)"
    rf")"
)


@dataclass(frozen=True)
class Bootstrap:
    """``words`` before a candidate make its pattern; a pattern is accepted with at least ``support``
    distinct known instances that are ``confidence`` of all its distinct instances."""

    words: int = 2
    support: int = 5
    confidence: float = 0.6


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        value = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = value * 2
        return total + F.when(i % 2 == 0, value).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return total % 10 == 0


def _is_card(match: Column) -> Column:
    return let(_digits(match), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))


def base_spans(text: Column) -> list[Column]:
    """The validated spans of each kind, in the order of KINDS."""
    return [
        spans(text, EMAIL),
        spans(text, IP, lambda m: F.rlike(m, F.lit(IP_PARTS))),
        spans(text, CARD, _is_card),
        spans(text, PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
    ]


def _pattern(before: Column, words: int) -> Column:
    context = F.rtrim(F.translate(ascii_lower(before), "\t\n\x0b\x0c\r", "     "))
    return F.substring_index(context, " ", -words)


def _candidates(text: Column, shape: str, words: int, letter: str = "A-Za-z") -> Column:
    """What has this shape, without its outer punctuation, with the words before it."""

    def candidate(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["match"], rf"^([^{letter}0-9+]*+)", 1))
        core = F.regexp_replace(F.substring(x["match"], lead + 1, F.length(x["match"])), rf"(?<=[{letter}0-9])[^{letter}0-9]*+$", "")
        return F.struct(
            (x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core)).alias("end"), core.alias("core"),
            _pattern(x["before"], words).alias("pattern"),
        )

    return F.transform(spans(text, shape), candidate)


def _meets(candidate: Column, found: list[Column], test) -> Column:
    """Whether any validated span stands in this relation to a candidate."""
    any_kind = F.lit(False)
    for kind in found:
        any_kind = any_kind | F.exists(kind, lambda s: test(s, candidate))
    return any_kind


def _holds(span: Column, candidate: Column) -> Column:
    return (span["start"] >= candidate["start"]) & (span["end"] <= candidate["end"])


def _overlaps(span: Column, candidate: Column) -> Column:
    return (span["start"] < candidate["end"]) & (candidate["start"] < span["end"])


def _bootstrap(edges: DataFrame, options: Bootstrap) -> tuple[DataFrame, DataFrame]:
    """Accepted (pattern) and learned (core), from edges (pattern, whole, core, known), one per triple.

    Candidates that begin at one place are one instance, and only the longest is learned.  What is
    learned never shrinks, nor what is accepted, so the rounds end.
    """
    seeds = edges.filter("known").select("core").distinct()
    learned, before = seeds, 0
    while True:
        hits = edges.join(learned.withColumn("hit", F.lit(1)), "core", "left").groupBy("pattern", "whole").agg(F.max("hit").alias("hit"))
        scored = hits.groupBy("pattern").agg(F.count("*").alias("instances"), F.count("hit").alias("support"))
        accepted = stage(scored.filter(
            (F.col("support") >= options.support) & (F.col("support") >= F.col("instances") * options.confidence)
        ).select("pattern"), "patterns")
        number = accepted.count()
        if number == before:
            return accepted, learned
        before = number
        whole = edges.filter(F.col("core") == F.col("whole"))
        learned = stage(
            whole.join(accepted, "pattern", "left_semi").select("core").union(seeds).distinct(), "instances"
        )


def find_personal(documents: DataFrame, options: Bootstrap = Bootstrap()) -> DataFrame:
    """(doc_id, version, email, ip, card, phone, context), a row per row of documents(doc_id, text, ...).

    Each kind is an array of (start, end) in code points, ends exclusive.  The first four hold the
    validated spans; ``context`` holds discovered candidates that overlap none of them and are not part
    of a longer one: tokens with a digit or an inner mark, and runs of tokens that look like one
    identifier.  A plain word is no candidate.  Null and empty texts hold nothing.  Rows with the same doc_id and text get the same result.  Other columns are
    ignored; an empty table gives an empty result.  The text is read once and not shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = documents.select(doc_key(F.col("doc_id"), F.col("text").cast("string")).alias("doc"), text.alias("text"))
    found = plain.select("doc", "text", *[c.alias(k) for k, c in zip(KINDS, base_spans(F.col("text")))])
    none = F.array().cast("array<struct<start:int,end:int,core:string,pattern:string>>")

    def if_any(test: str, value: Column) -> Column:
        return F.when(F.rlike("text", F.lit(test)), value).otherwise(none)

    letter, kinds = r"\p{L}", [F.col(k) for k in KINDS]
    tokens = if_any("[0-9]", _candidates(F.col("text"), TOKEN, options.words))
    marked = if_any(rf"\p{{L}}(?:[._@+~#\\-]|{_AT})\p{{L}}", _candidates(F.col("text"), MARKED, options.words, letter))
    runs = if_any(rf"[0-9]|(?i:at[)\]}}>]|{_GAP}at{_GAP})", _candidates(F.col("text"), RUN, options.words, letter))
    found = found.select("doc", *KINDS, tokens.alias("tokens"), F.concat(marked, runs).alias("shapes"))

    def listed(c: Column, core: Column, pattern: Column, known: Column, taken: Column) -> Column:
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), core.alias("core"), pattern.alias("pattern"),
            known.alias("known"), taken.alias("taken"),
        )

    # A token that holds a validated span is a seed; one that is a part of a span says nothing.  A span
    # that no token holds is a seed itself.
    seeds = [F.transform(
        F.filter(kind, lambda s: ~F.exists("tokens", lambda c: _holds(s, c))),
        lambda s: listed(s, s["match"], _pattern(s["before"], options.words), F.lit(True), F.lit(True)),
    ) for kind in kinds]
    marked = found.select(
        "doc", *[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS],
        F.concat(
            F.transform("tokens", lambda c: listed(c, c["core"], c["pattern"], _meets(c, kinds, _holds), _meets(c, kinds, _overlaps))),
            F.transform("shapes", lambda c: listed(c, c["core"], c["pattern"], F.lit(False), _meets(c, kinds, _overlaps))),
            *seeds,
        ).alias("tokens"),
    )
    marked = stage(marked, "marked")
    tokens = marked.select("doc", F.explode("tokens").alias("t")).select("doc", "t.*")
    tokens = tokens.filter("pattern <> '' AND core <> '' AND (known OR NOT taken)")
    place = Window.partitionBy("doc", "start")
    tokens = stage(tokens.withColumn("whole", F.max_by("core", "end").over(place)), "candidates")
    edges = stage(tokens.groupBy("pattern", "whole", "core").agg(F.max("known").alias("known")), "edges")
    accepted, learned = _bootstrap(edges, options)
    unseen = tokens.filter("NOT known")
    whole = unseen.filter(F.col("core") == F.col("whole"))
    extra = whole.join(accepted, "pattern", "left_semi").unionByName(unseen.join(learned, "core", "left_semi"))
    extra = extra.groupBy("doc", "start").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    extra = extra.withColumn("reached", F.coalesce(F.max("end").over(earlier), F.lit(0))).filter("end > reached")
    extra = extra.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("context"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return marked.drop("tokens").join(extra, "doc", "left").select(
        "doc.*", *KINDS, F.coalesce("context", empty).alias("context")
    )
