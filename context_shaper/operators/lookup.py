"""Values by ordered patterns, where the table of patterns is data.

The built-in tables are one CASE chain (``functions.models``); a caller's table may have thousands of rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from context_shaper import fixed_values as V
from context_shaper.session import stage

WINDOW_TABLE = "priority int, pattern string, context_window bigint"
PRICE_TABLE = "priority int, pattern string, input_per_m double, output_per_m double, cache_read_per_m double"


def window_table(spark: SparkSession) -> DataFrame:
    """The built-in context windows as rows."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(V.MODEL_WINDOWS)], WINDOW_TABLE)


def price_table(spark: SparkSession) -> DataFrame:
    """The built-in prices as rows."""
    return spark.createDataFrame([(i, pattern, *prices) for i, (pattern, prices) in enumerate(V.MODEL_PRICES)], PRICE_TABLE)


# Plain characters, with dots only where they stand for themselves.
_WHOLE_NAME = r"^\^([A-Za-z0-9 :_/@,~&=!%-]|\[[.]\]|\\[.])*+\$\z"


def _lower(text: Column) -> Column:
    """Lower case as patterns ignore it: letters A to Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def pattern_values(names: DataFrame, table: DataFrame) -> DataFrame:
    """Per name(name) that some pattern is found in, the other columns of the first such row.

    ``table`` holds priority, pattern and any values; patterns ignore case, the least priority wins, and of equal
    ones the least pattern.  Patterns that stand for one whole name, ``^plain text$``, meet it by equality, however
    many there are.  Names are tested once each against the others.  All sides are staged, so the planner sends the
    smaller one to all tasks by its own size limit.
    """
    different = stage(names.select("name").filter(F.col("name").isNotNull()).distinct(), "names")
    patterns = stage(table.withColumn("_exact", F.col("pattern").rlike(_WHOLE_NAME)), "patterns")
    values = [name for name in table.columns if name not in ("priority", "pattern")]
    columns = ["name", "priority", "pattern", *values]
    loose = stage(patterns.filter(~F.col("_exact")), "loose-patterns")
    tested = loose.join(different, F.rlike("name", F.concat(F.lit("(?i)"), "pattern")))
    exact = patterns.filter("_exact").withColumn("_key", _lower(F.regexp_replace("pattern", r"^\^|\[(?=[.])|(?<=[.])\]|\\(?=[.])|\$$", "")))
    # As in a pattern, the end of a name may be followed by one line end.
    keyed = different.withColumn("_key", _lower(F.regexp_replace("name", r"(\r\n|[\n\r\x{85}\x{2028}\x{2029}])\z", "")))
    met = tested.select(*columns).unionByName(exact.join(keyed, "_key").select(*columns))
    first = F.min_by(F.struct(*values), F.struct("priority", "pattern")).alias("first")
    return met.groupBy("name").agg(first).select("name", "first.*")


def with_pattern_values(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Rows with the table's values for the name in ``column``; null where no pattern fits."""
    values = pattern_values(rows.select(F.col(column).alias("name")), table).withColumnRenamed("name", "_name")
    return rows.join(values, rows[column] == F.col("_name"), "left").drop("_name")
