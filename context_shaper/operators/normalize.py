"""Conversations of any accepted format to the ``messages`` table, one row per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from context_shaper import fixed_values as V
from context_shaper.operators import blocks as B
from context_shaper.operators.ordering import compute_once, dense_positions
from context_shaper.sources.documents import open_documents

MESSAGES_SCHEMA = (
    "conv_id string, pos bigint, msg_index bigint, role string, given_role string, kind string, "
    "text string, tool_name string, tool_call_text string, has_binary boolean, "
    "has_tool_block boolean, is_tool_result boolean, content_is_list boolean, "
    "opt_text string, frame_prefix string, frame_suffix string, doc_format string, "
    "has_system boolean, model string"
)
MESSAGE_COLUMNS = [field.strip().split(" ")[0] for field in MESSAGES_SCHEMA.split(",")]

_MESSAGE = "struct<role:string,content:string,tool_calls:array<string>>"
_TOOL_CALL = "struct<name:string,input:string,function:struct<name:string,arguments:string>>"


def category_of(kind: Column) -> Column:
    chain = F.when(kind.isNull(), F.lit("other"))
    for name, category in V.KIND_TO_CATEGORY.items():
        chain = chain.when(kind == name, category)
    return chain.otherwise("other")


def kind_of(role: Column, block_kind: Column, has_calls: Column) -> Column:
    """Later rules win: plain role, tool blocks, the tool role, attached tool calls."""
    return (
        F.when(has_calls, "tool_call")
        .when(role == "tool", "tool_result")
        .when(block_kind.isNotNull(), block_kind)
        .when(role.isin(*V.PLAIN_ROLES), role)
        .otherwise("other")
    )


def _call_parts(calls: Column) -> Column:
    def read(call: Column) -> Column:
        name = F.coalesce(call["function"]["name"], call["name"])
        arguments = F.coalesce(
            call["function"]["arguments"], B.plain_json(call["input"]), F.lit("{}")
        )
        text = F.concat(
            F.lit("[tool call: "), F.coalesce(name, F.lit("undefined")), F.lit("] "), arguments
        )
        return F.struct(name.alias("name"), text.alias("text"))

    return F.transform(F.transform(calls, lambda raw: F.from_json(raw, _TOOL_CALL)), read)


def normalize_fragments(rows: DataFrame, attached_calls: bool = True) -> DataFrame:
    """rows(conv_id, pos, msg_index, fragment, doc_format, has_system, model) -> messages.

    ``attached_calls=False`` reads only role and content, as session transcripts require.
    """
    keys = ["conv_id", "pos", "msg_index", "model"]
    carried = {name: F.col(name) for name in ("doc_format", "has_system")}
    opened = compute_once(
        rows, [*keys, "doc_format", "has_system", "fragment"], {"m": F.from_json("fragment", _MESSAGE)}
    )
    message = F.col("m")
    opened = compute_once(
        opened, keys,
        carried | {
            "given_role": message["role"],
            "plain": B.json_text(F.col("fragment"), message["content"]),
            "elements": B.list_elements(F.col("fragment"), message["content"]),
            "raw_calls": message["tool_calls"] if attached_calls else F.lit(None).cast("array<string>"),
        },
    )
    read = compute_once(
        opened, keys,
        carried | {
            "is_external_system": F.col("msg_index") == -1,
            "given_role": F.col("given_role"),
            "plain": F.col("plain"),
            "blocks": B.read_blocks("elements"),
            "calls": F.when(F.size("raw_calls") > 0, _call_parts(F.col("raw_calls"))),
        },
    )
    blocks, calls = F.col("blocks"), F.col("calls")
    is_list = blocks.isNotNull()
    role = F.coalesce("given_role", F.lit("user"))
    block_calls = F.filter(F.transform(blocks, lambda b: b["call"]), lambda c: c.isNotNull())
    call_text = F.concat(
        F.coalesce(F.array_join(block_calls, ""), F.lit("")),
        F.coalesce(F.array_join(F.transform(calls, lambda c: c["text"]), "\n"), F.lit("")),
    )
    text = F.concat(
        F.when(is_list, F.array_join(F.transform(blocks, lambda b: b["text"]), "")).otherwise(F.col("plain")),
        F.coalesce(F.array_join(F.transform(calls, lambda c: c["text"]), "\n"), F.lit("")),
    )
    result_block = F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))
    tool_block = F.coalesce(
        F.exists(blocks, lambda b: b["type"].isin("tool_use", "tool_result")), F.lit(False)
    )
    ordinary = ~F.col("is_external_system")
    frame = B.rewrite_frame("blocks")
    return read.select(
        "conv_id", "pos", "msg_index",
        role.alias("role"),
        "given_role",
        F.when(ordinary, kind_of(role, B.last_tool_kind(blocks), calls.isNotNull()))
        .otherwise("system").alias("kind"),
        text.alias("text"),
        F.when(
            ordinary,
            F.when(calls.isNotNull(), F.get(calls, F.lit(0))["name"]).otherwise(B.last_tool_name(blocks)),
        ).alias("tool_name"),
        F.when(ordinary & (call_text != ""), call_text).alias("tool_call_text"),
        F.coalesce(F.exists(blocks, lambda b: b["binary"]), F.lit(False)).alias("has_binary"),
        (ordinary & tool_block).alias("has_tool_block"),
        ((role == "tool") | result_block).alias("is_tool_result"),
        is_list.alias("content_is_list"),
        F.when(is_list, F.array_join(F.transform(blocks, lambda b: b["joined"]), "\n"))
        .otherwise(F.col("plain")).alias("opt_text"),
        F.coalesce(frame["prefix"], F.lit("")).alias("frame_prefix"),
        F.coalesce(frame["suffix"], F.lit("")).alias("frame_suffix"),
        "doc_format", "has_system", "model",
    )


def normalize(raw: DataFrame) -> DataFrame:
    """raw(conv_id, body[, model]) -> messages.  A narrow transformation: nothing is shuffled."""
    documents = open_documents(raw).filter(F.col("parse_error").isNull())
    rows = documents.select(
        "conv_id", "model", "doc_format", "has_system",
        F.posexplode("fragments").alias("pos", "fragment"),
    )
    offset = F.col("has_system").cast("int")
    return normalize_fragments(
        rows.withColumn("msg_index", (F.col("pos") - offset).cast("bigint")).withColumn(
            "pos", F.col("pos").cast("bigint")
        )
    )


def plain_messages(rows: DataFrame, doc_format: str = "array") -> DataFrame:
    """rows(conv_id, pos, role, text[, model]) with string content -> messages.

    ``pos`` must already be 0, 1, 2, ... inside each conversation; see ``from_turns``.
    """
    if "model" not in rows.columns:
        rows = rows.withColumn("model", F.lit(None).cast("string"))
    role = F.coalesce("role", F.lit("user"))
    text = F.coalesce("text", F.lit('""'))
    no_text = F.lit(None).cast("string")
    no = F.lit(False)
    return rows.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("pos").cast("bigint").alias("pos"),
        F.col("pos").cast("bigint").alias("msg_index"),
        role.alias("role"),
        F.col("role").alias("given_role"),
        kind_of(role, no_text, no).alias("kind"),
        text.alias("text"),
        no_text.alias("tool_name"),
        no_text.alias("tool_call_text"),
        no.alias("has_binary"),
        no.alias("has_tool_block"),
        (role == "tool").alias("is_tool_result"),
        no.alias("content_is_list"),
        text.alias("opt_text"),
        F.lit("").alias("frame_prefix"),
        F.lit("").alias("frame_suffix"),
        F.lit(doc_format).alias("doc_format"),
        no.alias("has_system"),
        "model",
    )


def from_turns(table: DataFrame, conv_id: str, turn: str, dense: bool = True) -> DataFrame:
    """A message table (conversation, turn number, role, text) -> messages.

    With ``dense=False`` turn numbers may have gaps or start anywhere; positions are then
    computed, without sorting a whole conversation in one task.
    """
    rows = table.withColumnsRenamed({conv_id: "conv_id", turn: "turn"})
    if dense:
        return plain_messages(rows.withColumn("pos", F.col("turn")))
    return plain_messages(dense_positions(rows, ["conv_id"], "turn", "pos"))


def conversations(raw: DataFrame) -> DataFrame:
    """One row per readable document, empty ones included: format and number of messages."""
    documents = open_documents(raw).filter(F.col("parse_error").isNull())
    own = F.slice("fragments", F.when(F.col("has_system"), 2).otherwise(1), F.size("fragments"))
    contents = F.transform(own, lambda m: F.from_json(m, "struct<content:array<string>>")["content"])
    has_tools = F.exists(
        contents,
        lambda c: F.coalesce(
            F.exists(
                c,
                lambda b: F.from_json(b, "struct<type:string>")["type"].isin("tool_use", "tool_result"),
            ),
            F.lit(False),
        ),
    )
    return documents.select(
        "conv_id",
        source_format(F.col("doc_format"), F.col("has_system"), has_tools).alias("source_format"),
        F.size("fragments").cast("bigint").alias("message_count"),
        "model",
        "body_model",
        "has_list",
    )


def source_format(doc_format: Column, has_system: Column, has_tool_block: Column) -> Column:
    return F.when(doc_format != "object", doc_format).when(
        has_system | has_tool_block, "anthropic"
    ).otherwise("openai")
