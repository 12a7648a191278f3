"""Write rewritten texts back into conversation documents.

Which messages change, and to what, is decided by DataFrame expressions.  Only replacing a
value inside a JSON document needs Python, through Arrow, and only for changed documents.
"""

from __future__ import annotations

import json
import re
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from context_shaper import fixed_values as V


_SPACE = re.compile(r"[ \t\n\r]*")


@cache
def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(strict=False)


def _decode(text: str, at: int):
    """The value at this place, and where it ends."""
    return _decoder().raw_decode(text, at)


def _skip(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _parts(text: str, at: int = 0) -> list[tuple[str | None, int, int]]:
    """(name, start, end) of the values of the JSON object or list at ``at``; elements have no name.

    Only places are taken from the text: what is not replaced stays as it was written.
    """
    at = _skip(text, at)
    named, at = text[at] == "{", _skip(text, at + 1)
    found = []
    while text[at] not in "}]":
        name = None
        if named:
            name, at = _decode(text, at)
            at = _skip(text, _skip(text, at) + 1)
        end = _decode(text, at)[1]
        found.append((name, at, end))
        at = _skip(text, end)
        if text[at] == ",":
            at = _skip(text, at + 1)
    return found


def _splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with its spans (start, end) replaced."""
    pieces, at = [], 0
    for start, end, new in sorted(edits):
        pieces += [text[at:start], new]
        at = end
    return "".join([*pieces, text[at:]])


def _member(text: str, name: str, at: int = 0) -> tuple[int, int] | None:
    """Where the object's last member of this name has its value; that one counts in JSON."""
    return next(((start, end) for key, start, end in reversed(_parts(text, at)) if key == name), None)


def _with_member(block: str, name: str, value: str) -> str:
    """An object's text with one member replaced, or added at its end."""
    place = _member(block, name)
    if place:
        return _splice(block, [(*place, value)])
    comma = "," if _parts(block) else ""
    end = block.rindex("}")
    return f"{block[:end]}{comma}{json.dumps(name)}:{value}{block[end:]}"


def place_text(content: str, text: str) -> str:
    """JSON content with its text replaced; everything else keeps its spelling.

    The first text or tool result of a list takes the text, later results say that theirs is gone,
    later texts and empty values go, and a list that holds neither gets a text of its own.
    """
    new = json.dumps(text, ensure_ascii=False)
    if not content.lstrip(" \t\n\r").startswith("["):
        return new
    blocks, placed = [], False
    for _, start, end in _parts(content):
        raw, value = content[start:end], _decode(content, start)[0]
        kind = value.get("type") if isinstance(value, dict) else None
        field = {"text": "text", "tool_result": "content"}.get(kind) if isinstance(kind, str) else None
        if field and not (placed and kind == "text"):
            blocks.append(_with_member(raw, field, json.dumps(V.REMOVED_BLOCK, ensure_ascii=False) if placed else new))
        elif not field and (value or isinstance(value, (dict, list))):
            blocks.append(raw)
        placed = placed or field is not None
    if not placed:
        blocks.append(f'{{"type":"text","text":{new}}}')
    return f"[{','.join(blocks)}]"


def _is_document(body: str) -> bool:
    """Whether a body is a list of messages, or an object with one; a raw text is neither."""
    try:
        value, end = _decode(body, _skip(body, 0))
    except ValueError:
        return False
    messages = value.get("messages") if isinstance(value, dict) else value
    return isinstance(messages, list) and _skip(body, end) == len(body)


def _rewrite_body(body: str, changes, keep_from, stub) -> str:
    if not _is_document(body):
        return body
    listed = body.lstrip(" \t\n\r").startswith("[")
    first, last = (0, len(body)) if listed else _member(body, "messages")
    places, edits = _parts(body, first), []
    for change in changes if changes is not None else ():
        _, start, end = places[change["idx"]]
        message = body[start:end]
        at = _member(message, "content")
        content = place_text(message[slice(*at)], change["placed"]) if at else json.dumps(change["placed"], ensure_ascii=False)
        edits.append((start, end, _with_member(message, "content", content)))
    if keep_from is not None and keep_from == keep_from:
        start = int(keep_from)
        head = f'{{"role":"user","content":{json.dumps(stub, ensure_ascii=False)}}}'
        kept = places[start][1] if start < len(places) else None
        edits = [edit for edit in edits if kept is not None and edit[0] >= kept]
        edits.append((places[0][1], kept if kept is not None else places[-1][2], head + ("," if kept is not None else "")))
    return _splice(body, edits)


@F.pandas_udf(StringType())
def _rewrite_bodies(
    bodies: pd.Series, changes: pd.Series, keep_from: pd.Series, stubs: pd.Series
) -> pd.Series:
    return pd.Series([
        None if body is None else _rewrite_body(body, change, start, stub)
        for body, change, start, stub in zip(bodies, changes, keep_from, stubs, strict=True)
    ])


def rewrite_documents(
    raw: DataFrame, rewritten: DataFrame, points: DataFrame | None = None
) -> DataFrame:
    """raw(conv_id, body) with the changes written in: conv_id, body, changed.

    A document is one row, so the list of its changes is bounded by the document itself.
    Unchanged bodies are passed on as they are and never leave the JVM.
    """
    changes = rewritten.filter("changed").groupBy("conv_id").agg(
        F.collect_list(F.struct("idx", "placed")).alias("changes")
    )
    if points is None:
        edits = changes.withColumn("keep_from", F.lit(None).cast("bigint")).withColumn(
            "stub", F.lit(None).cast("string")
        )
    else:
        edits = changes.join(points.select("conv_id", "keep_from", "stub"), "conv_id", "full")
    joined = raw.select(F.col("conv_id").cast("string").alias("conv_id"), "body").join(
        edits, "conv_id", "left"
    )
    changed = F.col("changes").isNotNull() | F.col("keep_from").isNotNull()
    body = _rewrite_bodies(F.when(changed, F.col("body")), "changes", "keep_from", "stub")
    return joined.select(
        "conv_id", F.coalesce(body, F.col("body")).alias("body"), changed.alias("changed")
    )


@F.pandas_udf(StringType())
def _replace_contents(contents: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([
        None if text is None else place_text(content, text)
        for content, text in zip(contents, texts, strict=True)
    ])


def replace_contents(rows: DataFrame, content: str, text: str) -> DataFrame:
    """Replace a JSON content column where ``text`` is not null, keeping block structure."""
    chosen = F.when(F.col(text).isNotNull(), F.col(content))
    new = _replace_contents(chosen, F.col(text))
    return rows.withColumn(content, F.coalesce(new, F.col(content)))
