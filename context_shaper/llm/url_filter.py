"""Filtering URLs by host and path rules and, where none fits, by mined association rules.

Method: FP-growth mines combinations of URL tokens among the bad ones of the labelled URLs.  Tokens that
occur in the same labelled URLs are one item.  A combination is a rule if enough bad URLs hold it and
the lower bound of its confidence, counted over all labelled URLs, is high enough; a rule goes when a
part of it does as well.  A rule is filed under its rarest token and applied to the URLs that hold this
token and all its others.  Equal URLs are judged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from context_shaper.llm.native import ascii_lower
from context_shaper.session import stage


@dataclass(frozen=True)
class Mining:
    """A rule covers at least ``least`` bad URLs and a ``support`` share of all labelled URLs, and of
    those that it covers the lower ``deviations`` bound of the bad share is at least ``confidence``."""

    support: float = 0.0005
    least: int = 8
    confidence: float = 0.7
    deviations: float = 1.645


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path after the first ``://``; both empty for null and other texts."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The whole host, words of its labels and of the path, and names of the query's parameters."""
    def words(text: Column) -> Column:
        return F.filter(F.split(ascii_lower(text), r"[^a-z0-9_]+"), lambda w: (w != "") & ~F.rlike(w, F.lit("^[0-9]+$")))

    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)), lambda n: n != "")

    def tagged(tag: str, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.concat(F.lit(tag), t))

    return F.array_distinct(F.concat(
        tagged("at:", F.array(host)), tagged("host:", words(host)), tagged("path:", words(path)), tagged("ask:", names)
    ))


def lower_bound(hits: Column, count: Column, deviations: float) -> Column:
    """The lower end of the score interval of a share of ``hits`` in ``count``."""
    z = float(deviations) ** 2
    share = hits / count
    return (share + z / (2 * count) - deviations * F.sqrt((share * (1 - share) + z / (4 * count)) / count)) / (1 + z / count)


def _fitting(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows(tokens, ...) joined with the rules(key, all, ...) whose tokens they hold."""
    holding = rows.withColumn("key", F.explode("tokens"))
    return holding.join(rules, "key").filter(F.size(F.array_except("all", "tokens")) == 0)


def mine_rules(labelled: DataFrame, options: Mining = Mining()) -> DataFrame:
    """(key, all, bad, covered, bound) of the rules that labelled(tokens, bad) gives: the tokens of a
    rule in order, its rarest token, and the labelled rows it covers.  Rows without tokens or label
    are ignored; too few bad rows, no rule."""
    rows = stage(
        labelled.filter("bad IS NOT NULL AND size(tokens) > 0")
        .select("bad", "tokens", F.monotonically_increasing_id().alias("row")), "mining-rows",
    )
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    needed = max(options.least, 1, -int(-options.support * total // 1))
    empty = rows.sparkSession.createDataFrame([], "key string, `all` array<string>, bad bigint, covered bigint, bound double")
    if bad < needed:
        return empty
    # Tokens of the same rows are one item, named by the first of them.
    mixed = F.xxhash64("row")
    items = stage(
        rows.withColumn("token", F.explode("tokens")).groupBy("token").agg(
            F.count("*").alias("covered"), F.count_if("bad").alias("bad"),
            F.bit_xor(mixed).alias("x"), F.sum(mixed.cast("decimal(38,0)")).alias("y"),
        ).filter(F.col("bad") >= needed).groupBy("covered", "bad", "x", "y").agg(F.min("token").alias("token")), "items",
    )
    baskets = rows.filter("bad").select("row", F.explode("tokens").alias("token")).join(items.select("token"), "token")
    baskets = stage(baskets.groupBy("row").agg(F.collect_list("token").alias("items")), "baskets")
    held = baskets.count()
    if held < needed:
        return empty
    # Half a row less, so that rounding never asks for a row more.
    model = FPGrowth(itemsCol="items", minSupport=(needed - 0.5) / held, minConfidence=1.0).fit(baskets)
    sets = stage(model.freqItemsets.select(F.array_sort("items").alias("all"), F.col("freq").alias("bad")), "itemsets")
    rare = sets.select("all", "bad", F.explode("all").alias("token")).join(items.select("token", F.col("covered").alias("n")), "token")
    keyed = stage(rare.groupBy("all", "bad").agg(F.min_by("token", F.struct("n", "token")).alias("key")), "keyed-itemsets")
    covered = _fitting(rows.select("tokens"), keyed.select("key", "all")).groupBy("all").agg(F.count("*").alias("covered"))
    rules = keyed.join(covered, "all").withColumn(
        "bound", lower_bound(F.col("bad"), F.col("covered"), options.deviations)
    ).filter(F.col("bound") >= options.confidence)
    rules = stage(rules.select("key", "all", "bad", "covered", "bound"), "rules")
    # A rule goes if fewer of its tokens bound the share as high.
    parts = rules.select("key", "all", F.col("bound").alias("part_bound"))
    whole = rules.select(F.col("all").alias("tokens"), "bound")
    beaten = _fitting(whole, parts).filter("size(all) < size(tokens) AND part_bound >= bound").select(
        F.col("tokens").alias("all")
    ).distinct()
    return rules.join(beaten, "all", "left_anti").select("key", "all", "bad", "covered", "bound")


def fixed_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, host, path, verdict) from pairs like ("block", "example.com/de/")."""
    rows = [(rule, rule.partition("/")[0], "/" + rule.partition("/")[2], verdict) for verdict, rule in rules]
    return spark.createDataFrame(rows, "rule string, host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, labelled: DataFrame, options: Mining = Mining()) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url, ...).

    The longest of ``rules`` (see fixed_rules; equal lengths: the smaller in name) that fits host and
    path decides.  Otherwise the URL is blocked if a mined rule fits and allowed if not.  ``labelled``
    has (url, bad); a URL labelled both ways counts as bad.  Null urls and texts without ``://`` have
    empty host and path, no tokens, and are allowed.  Repeated rows keep their own row.  Other columns
    are ignored; without labelled rows nothing is mined; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    parsed = stage(
        pages.select(F.col("url").cast("string").alias("url")).distinct().withColumns({"host": host, "path": path})
        .withColumn("tokens", F.when(F.col("host") != "", url_tokens(F.col("url"), F.col("host"), F.col("path")))), "urls",
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    candidates = parsed.filter("host <> ''").select("url", "path", F.explode(F.array_distinct(suffixes)).alias("host"))
    fitting = candidates.join(rules.withColumnRenamed("path", "start"), "host").filter(F.startswith("path", F.col("start")))
    decided = fitting.groupBy("url").agg(
        F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), F.col("rule"))).alias("fixed")
    )
    known = labelled.filter("bad IS NOT NULL AND url IS NOT NULL").groupBy("url").agg(F.max("bad").alias("bad"))
    sample = stage(parsed.join(known, "url").select("tokens", "bad"), "labelled")
    mined = stage(mine_rules(sample, options).select("key", "all"), "mined")
    blocked = _fitting(parsed.filter("tokens IS NOT NULL").select("url", "tokens"), mined).select(
        "url", F.lit("block").alias("mined")
    ).distinct()
    judged = parsed.join(decided, "url", "left").join(blocked, "url", "left").select(
        F.col("url").alias("_url"), "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "mined", F.lit("allow")).alias("verdict"),
    )
    return pages.select("page_id", F.col("url").cast("string").alias("url")).join(
        judged, F.col("url").eqNullSafe(F.col("_url"))
    ).select("page_id", "host", "path", "rule", "verdict")
