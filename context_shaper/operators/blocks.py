"""Message content to text.

A message's content is a string, a list of blocks, or something else.  Two readings are
needed: the profiler's text (blocks concatenated, tool calls spelled out) and the rewriter's
text (blocks joined by newlines, only text, tool results and tool inputs).  Raw JSON
fragments keep key order; VARIANT is used only to tell strings from other list elements.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from context_shaper.functions.text import bind, built_once

# Raw fields of one block.  A field that is not a string arrives as compact JSON text.
_BLOCK = (
    "struct<type:string,text:string,name:string,input:string,thinking:string,content:string>"
)
_LIST_CONTENT = "struct<content:array<string>>"
_TYPED_CONTENT = "struct<content:array<variant>>"

# Names a tool result in JSON text as it is written here; counts how deep results can be nested.
_RESULT_NAME = '"tool_result"'


# Two escaped halves of one character, in text whose backslashes have been doubled.
_ESCAPED_PAIR = (
    r"(?<!\\)((?:\\{4})*)\\{2}(uD[89AB][0-9A-F]{2})\\{2}(uD[C-F][0-9A-F]{2})"
)


def plain_json(raw: Column) -> Column:
    """JSON text with characters outside the BMP written as themselves.

    Raw fragments spell them as two escapes.  The fragment is quoted as a JSON string in which
    only those escapes stay live, and read back; text without them is passed on untouched.
    """
    quoted = F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    live = F.regexp_replace(quoted, _ESCAPED_PAIR, r"$1\\$2\\$3")
    read = F.get(F.from_json(F.concat(F.lit('["'), live, F.lit('"]')), "array<string>"), F.lit(0))
    return F.when(F.contains(raw, F.lit("\\uD")), read).otherwise(raw)


def json_text(owner: Column, raw: Column) -> Column:
    """Text of ``owner.content`` that is not a list: itself, or two quotes when null or missing."""
    # A string may look like this too; only an object can be read as a map.
    escaped = raw.startswith("{") & F.contains(raw, F.lit("\\uD"))
    is_object = F.from_json(owner, "struct<content:map<string,string>>")["content"].isNotNull()
    text = F.when(escaped, F.when(is_object, plain_json(raw)).otherwise(raw)).otherwise(raw)
    return F.coalesce(text, F.lit('""'))


def list_elements(owner: Column, raw_content: Column) -> Column:
    """Elements of ``owner.content`` as structs (raw, is_string); null when it is no list.

    Strings lose their quotes in ``raw``, so when the elements do not add up to the raw list
    some of them are strings, and only then their types are looked up.
    """
    def described(raws: Column) -> Column:
        rebuilt = F.concat(F.lit("["), F.array_join(raws, ",", "null"), F.lit("]"))
        plain = F.transform(
            raws, lambda raw: F.struct(raw.alias("raw"), F.lit(False).alias("is_string"))
        )
        mixed = bind(
            F.from_json(owner, _TYPED_CONTENT)["content"],
            lambda typed: F.transform(
                raws,
                lambda raw, i: F.struct(
                    raw.alias("raw"),
                    (F.schema_of_variant(F.get(typed, i)) == "STRING").alias("is_string"),
                ),
            ),
        )
        return F.when(raws.isNotNull(), F.when(rebuilt == raw_content, plain).otherwise(mixed))

    return bind(F.from_json(owner, _LIST_CONTENT)["content"], described)


def _tool_input(block: Column) -> Column:
    return F.coalesce(plain_json(block["input"]), F.lit("{}"))


def _nested_elements(owner: Column, content: Column) -> Column:
    """Elements of a tool result's list with results inside it replaced by their own elements.

    The texts of nested results are put together like those of one long list, whatever the depth,
    so each step opens one level.  As many steps are planned as the text can hold levels; once a step has
    found nothing to open, the others do nothing.  A result with an empty list stands for one empty string.
    """
    empty = F.array(F.struct(F.lit("").alias("raw"), F.lit(True).alias("is_string")))

    def opened(element: Column) -> Column:
        """The elements that stand for this one, and whether it was a result with a list."""
        same = F.struct(F.array(element).alias("elements"), F.lit(False).alias("more"))

        def inner(block: Column) -> Column:
            inside = F.when(block["type"] == "tool_result", list_elements(element["raw"], block["content"]))
            return bind(inside, lambda e: F.when(e.isNull(), same).otherwise(
                F.struct(F.when(F.size(e) == 0, empty).otherwise(e).alias("elements"), F.lit(True).alias("more"))
            ))

        may_nest = ~F.coalesce(element["is_string"], F.lit(False)) & F.contains(element["raw"], F.lit(_RESULT_NAME))
        return F.when(may_nest, bind(F.from_json(element["raw"], _BLOCK), inner)).otherwise(same)

    def level(state: Column, _: Column) -> Column:
        step = bind(F.transform(state["elements"], opened), lambda found: F.struct(
            F.flatten(F.transform(found, lambda x: x["elements"])).alias("elements"),
            F.exists(found, lambda x: x["more"]).alias("more"),
        ))
        return F.when(state["more"], step).otherwise(state)

    names = F.length(content) - F.length(F.replace(content, F.lit(_RESULT_NAME), F.lit("")))
    levels = (names / len(_RESULT_NAME)).cast("int")
    nested = list_elements(owner, content)
    start = lambda e: F.struct(e.alias("elements"), F.lit(True).alias("more"))
    return F.when(
        levels > 0,
        bind(nested, lambda e: F.aggregate(F.sequence(F.lit(1), levels), start(e), level, lambda state: state["elements"])),
    ).otherwise(nested)


def _read_element(element: Column, nested: bool = False) -> Column:
    """One list element as a struct of everything later steps ask about it."""
    parsed = F.struct(
        element["raw"].alias("raw"),
        element["is_string"].alias("is_string"),
        F.when(~element["is_string"], F.from_json(element["raw"], _BLOCK)).alias("block"),
    )
    if nested:
        return bind(parsed, lambda e: _describe(e, None))

    def with_inner(e: Column) -> Column:
        inside = F.when(
            e["block"]["type"] == "tool_result", _nested_elements(e["raw"], e["block"]["content"])
        )
        inner = F.transform(inside, lambda n: _read_element(n, nested=True))
        return F.struct(e.alias("e"), inner.alias("inner"))

    return bind(parsed, lambda e: bind(with_inner(e), lambda pair: _describe(pair["e"], pair["inner"])))


def _describe(element: Column, inner: Column | None) -> Column:
    raw, is_string, block = element["raw"], element["is_string"], element["block"]
    kind = block["type"]
    is_result = kind == "tool_result"
    if inner is not None:
        inner_text = F.array_join(F.transform(inner, lambda b: b["text"]), "")
        inner_joined = F.array_join(F.transform(inner, lambda b: b["joined"]), "\n")
        inner_binary = F.exists(inner, lambda b: b["binary"])
    else:
        inner_text = inner_joined = F.lit(None).cast("string")
        inner_binary = F.lit(False)
    result_text = F.coalesce(inner_text, json_text(raw, block["content"]))
    result_joined = F.coalesce(inner_joined, json_text(raw, block["content"]))

    call = F.concat(
        F.lit("[tool call: "),
        F.coalesce(block["name"], F.lit("undefined")),
        F.lit("] "),
        _tool_input(block),
    )
    text = (
        F.when(kind == "text", F.coalesce(block["text"], F.lit("")))
        .when(kind == "tool_use", call)
        .when(is_result, result_text)
        .when(kind.isin("image", "document"), F.concat(F.lit("["), kind, F.lit("]")))
        .when(kind == "thinking", F.coalesce(block["thinking"], F.lit("")))
        .when(kind == "redacted_thinking", F.lit("[redacted thinking]"))
        .otherwise(F.coalesce(F.when(is_string, raw).otherwise(plain_json(raw)), F.lit("")))
    )
    joined = (
        F.when(is_string, raw)
        .when(kind == "text", F.coalesce(block["text"], F.lit("")))
        .when(is_result, result_joined)
        .when(kind == "tool_use", _tool_input(block))
        .otherwise(F.lit(""))
    )
    # Empty strings, zeros, false and null do not survive a rewrite.
    survives = raw.isNotNull() & F.when(is_string, raw != "").otherwise(
        ~raw.isin("0", "-0", "0.0", "-0.0", "false")
    )
    return F.struct(
        kind.alias("type"),
        text.alias("text"),
        joined.alias("joined"),
        F.when(kind == "tool_use", call).alias("call"),
        F.when(kind == "tool_use", block["name"]).alias("name"),
        F.coalesce(
            kind.isin("image", "document")
            | (is_result & F.coalesce(inner_binary, F.lit(False))),
            F.lit(False),
        ).alias("binary"),
        survives.alias("survives"),
    )


@built_once
def read_blocks(elements: str) -> Column:
    """Structs (type, text, joined, call, name, binary, survives) per element."""
    return F.transform(F.col(elements), lambda element: _read_element(element))


def last_tool_kind(blocks: Column) -> Column:
    """tool_call or tool_result after the last tool block; null without one."""
    tools = F.filter(blocks, lambda b: b["type"].isin("tool_use", "tool_result"))
    last = F.get(tools, F.size(tools) - 1)["type"]
    return F.when(last == "tool_use", "tool_call").when(last == "tool_result", last)


def last_tool_name(blocks: Column) -> Column:
    named = F.filter(blocks, lambda b: b["name"].isNotNull())
    return F.get(named, F.size(named) - 1)["name"]


@built_once
def rewrite_frame(blocks: str) -> Column:
    """Struct (prefix, suffix): what surrounds replaced text in the rewriter's reading.

    A rewrite puts new text into the first tool result or text block, empties later tool
    results, drops later text blocks and keeps the rest; without such a block it appends one.
    """
    def split(alive: Column) -> Column:
        holds = F.transform(
            alive, lambda b: F.coalesce(b["type"].isin("tool_result", "text"), F.lit(False))
        )
        return bind(
            F.struct(alive.alias("alive"), F.array_position(holds, F.lit(True)).cast("int").alias("at")),
            lambda pair: _frame_around(pair["alive"], pair["at"]),
        )

    return bind(F.filter(F.col(blocks), lambda b: b["survives"]), split)


def _frame_around(alive: Column, at: Column) -> Column:
    before = F.when(at > 0, F.slice(alive, 1, F.greatest(at - 1, F.lit(0)))).otherwise(alive)
    after = F.when(at > 0, F.slice(alive, at + 1, F.size(alive))).otherwise(F.slice(alive, 1, 0))
    kept_after = F.filter(after, lambda b: F.coalesce(b["type"] != "text", F.lit(True)))
    prefix = F.array_join(F.transform(before, lambda b: F.concat(b["joined"], F.lit("\n"))), "")
    suffix = F.array_join(
        F.transform(
            kept_after,
            lambda b: F.concat(
                F.lit("\n"),
                F.when(b["type"] == "tool_result", F.lit("[removed]")).otherwise(b["joined"]),
            ),
        ),
        "",
    )
    return F.struct(prefix.alias("prefix"), suffix.alias("suffix"))
