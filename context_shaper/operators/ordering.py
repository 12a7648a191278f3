"""Positions, group facts and per-conversation joins that hold up under one hot key.

A conversation (or a group of identical texts) may hold a third of all rows.  Windows and
joins therefore never run over a whole such group.  They run over chunks of it, cut by
position, and combine the chunk results, which are fewer by the chunk size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS = 65_536


def compute_once(rows: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Select ``keep`` and computed ``columns`` so that each is evaluated once per row.

    ``inline`` over a one-element list is a step the optimizer does not merge with later ones:
    a filter on a computed hash reads the column instead of hashing the text a second time.
    """
    struct = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select(*keep, F.inline(F.array(struct)))


def chunk_of(position: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(position / F.lit(chunk_rows)).cast("bigint")


def dense_positions(
    rows: DataFrame, keys: list[str], order: str, name: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Number rows 0, 1, 2, ... per key by a whole-number order column that is unique per key.

    Rows are ranked inside (key, range of order values) and shifted by the rows before that
    range.  Both sides of the join are clustered the same way, so rows are shuffled once.
    """
    chunked = rows.withColumn("_chunk", chunk_of(F.col(order), chunk_rows))
    group = [*keys, "_chunk"]
    ranked = chunked.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*group).orderBy(order))
    )
    sizes = chunked.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        ranked.join(offsets, group)
        .withColumn(name, (F.col("_offset") + F.col("_rank") - 1).cast("bigint"))
        .drop("_chunk", "_rank", "_offset")
    )


def repeated_groups(
    rows: DataFrame, keys: list[str], position: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Facts about groups with more than one row, one row per group and position chunk.

    Returns (*keys, _chunk, group_rows, first_position, part, parts).  Rows are combined before
    each shuffle; the window sees one row per chunk, not one per member.
    """
    per_chunk = (
        rows.withColumn("_chunk", chunk_of(F.col(position), chunk_rows))
        .groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(position).alias("_first"))
    )
    group = Window.partitionBy(*keys)
    return (
        per_chunk.withColumn("group_rows", F.sum("_rows").over(group))
        .withColumn("first_position", F.min("_first").over(group))
        .withColumn("part", F.row_number().over(group.orderBy("_chunk")) - 1)
        .filter(F.col("group_rows") > 1)
        .drop("_rows", "_first")
    )


def members_of_repeated_groups(
    rows: DataFrame, keys: list[str], position: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Rows of groups with more than one member, with group_rows, first_position and part."""
    facts = repeated_groups(rows, keys, position, chunk_rows)
    chunked = rows.withColumn("_chunk", chunk_of(F.col(position), chunk_rows))
    return chunked.join(facts, [*keys, "_chunk"])


def last_rows(rows: DataFrame, key: str, position: str, count: int) -> DataFrame:
    """The last ``count`` rows per key.

    The rank filter lets Spark keep only ``count`` rows per key and task before the shuffle.
    """
    ranked = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    )
    return ranked.filter(F.col("_rank") <= count).drop("_rank")


def top_rows(rows: DataFrame, key: str, order: list[Column], count: int, rank: str) -> DataFrame:
    """The first ``count`` rows per key in the given order, with their rank from 1."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col(rank) <= count)


def newest_rows(rows: DataFrame, order: list[Column], count: int, owner: str | None = None) -> DataFrame:
    """The first ``count`` rows in this order, of all or of every owner (a machine, user or project)."""
    if owner is None:
        return rows.orderBy(*order).limit(count)
    return top_rows(rows, owner, order, count, "_newest").drop("_newest")


def join_conversations(
    rows: DataFrame,
    facts: DataFrame,
    size: str,
    position: str,
    how: str = "inner",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Join rows to one fact row per conversation, a chunk of positions at a time.

    ``size`` names the fact column with the number of positions.  Each fact row is repeated
    once per chunk, so a join key matches at most ``chunk_rows`` rows.
    """
    spread = facts.withColumn(
        "_chunk",
        F.explode(F.sequence(F.lit(0).cast("bigint"), chunk_of(F.greatest(F.col(size) - 1, F.lit(0)), chunk_rows))),
    )
    chunked = rows.withColumn("_chunk", chunk_of(F.col(position), chunk_rows))
    return chunked.join(spread, ["conv_id", "_chunk"], how).drop("_chunk")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
