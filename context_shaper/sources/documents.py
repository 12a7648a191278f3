"""Conversation documents: one JSON (or raw text) body per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from context_shaper.operators.ordering import compute_once

# Closes the probe list behind a body.  A body is one JSON value exactly when the list
# ``[body, sentinel]`` has two elements and the second is the sentinel; parsing the body
# alone would accept trailing text.
_SENTINEL = "end-of-body-5f1c"
_STRICT = {"allowNonNumericNumbers": "false"}
_SHAPE = "struct<system:string,messages:array<string>,model:string>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """raw(conv_id, body, model, src_path) from a folder with one conversation per file."""
    files = spark.read.text(path, wholetext=True).withColumn("src_path", F.col("_metadata.file_path"))
    return files.select(
        F.col("src_path").alias("conv_id"),
        F.col("value").alias("body"),
        F.lit(None).cast("string").alias("model"),
        "src_path",
    )


def is_json(body: Column) -> Column:
    probe = F.from_json(
        F.concat(F.lit("["), body, F.lit(f',"{_SENTINEL}"]')), "array<string>", _STRICT
    )
    return F.coalesce((F.size(probe) == 2) & (F.get(probe, F.lit(1)) == _SENTINEL), F.lit(False))


def _system_as_message(system: Column, blocks: Column) -> Column:
    """The external system prompt written as a message, so both take the same path."""
    as_text = F.to_json(F.struct(F.lit("system").alias("role"), system.alias("content")))
    as_blocks = F.concat(F.lit('{"role":"system","content":'), system, F.lit("}"))
    return F.when(blocks.isNotNull() | system.startswith("{"), as_blocks).otherwise(as_text)


def open_documents(raw: DataFrame) -> DataFrame:
    """raw(conv_id, body[, model]) -> one row per document with its messages as JSON text.

    Columns: conv_id, model, body_model, doc_format (object, array or text), has_system,
    fragments (array of JSON messages, the system prompt first), parse_error.  A document that
    cannot be read as a conversation keeps its row, with ``parse_error`` set and no fragments.
    """
    if "model" not in raw.columns:
        raw = raw.withColumn("model", F.lit(None).cast("string"))
    body, first = F.col("body"), F.col("first")
    typed = compute_once(
        raw.select(F.col("conv_id").cast("string").alias("conv_id"), "body", F.col("model").alias("given_model")),
        ["conv_id", "given_model"],
        {
            "body": body,
            "first": F.when(is_json(body), F.regexp_extract(body, r"^[ \t\n\r]*(\S)", 1)),
        },
    )
    parsed = compute_once(
        typed, ["conv_id", "given_model"],
        {
            "body": body,
            "first": first,
            "list": F.when(first == "[", F.from_json(body, "array<string>", _STRICT)),
            "doc": F.when(first == "{", F.from_json(body, _SHAPE, _STRICT)),
            "shape": F.when(
                first == "{",
                F.from_json(body, "struct<system:array<string>,messages:string>", _STRICT),
            ),
        },
    )
    messages, system = F.col("doc")["messages"], F.col("doc")["system"]
    raw_text = F.to_json(F.struct(F.lit("user").alias("role"), F.col("body").alias("content")))
    fragments = (
        F.when(F.col("first").isNull(), F.array(raw_text))
        .when(F.col("first") == "[", F.col("list"))
        .when(
            F.col("first") == "{",
            F.concat(
                F.when(
                    system.isNotNull(),
                    F.array(_system_as_message(system, F.col("shape")["system"])),
                ).otherwise(F.array().cast("array<string>")),
                F.coalesce(messages, F.array().cast("array<string>")),
            ),
        )
        .otherwise(F.array().cast("array<string>"))
    )
    error = (
        F.when(F.col("body").isNull(), "no body")
        .when((F.col("first") == "n"), "null document")
        .when(
            (F.col("first") == "{") & messages.isNull() & F.col("shape")["messages"].isNotNull(),
            "messages is not a list",
        )
        .when(F.exists(F.coalesce("list", messages), lambda m: m.isNull()), "null message")
    )
    read = compute_once(
        parsed, ["conv_id"],
        {
            "model": F.coalesce("given_model", F.col("doc")["model"]),
            "body_model": F.col("doc")["model"],
            "doc_format": F.when(first.isNull(), "text").when(first == "[", "array").otherwise("object"),
            "has_system": F.coalesce(system.isNotNull(), F.lit(False)),
            "has_list": F.coalesce((first == "[") | messages.isNotNull(), F.lit(False)),
            "parse_error": error,
            "fragments": fragments,
        },
    )
    return read.withColumn("fragments", F.when(F.col("parse_error").isNull(), F.col("fragments")))


def rejected_documents(raw: DataFrame) -> DataFrame:
    """Documents that are JSON but no conversation, with the reason."""
    return (
        open_documents(raw)
        .filter(F.col("parse_error").isNotNull())
        .select("conv_id", "doc_format", "parse_error")
    )
