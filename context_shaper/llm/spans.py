"""Places of regular-expression matches, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from context_shaper.llm.native import let

_CHUNK = 256
SPAN = "struct<start:int,end:int,match:string,before:string>"


def _running(sizes: Column) -> Column:
    """The sum of the elements before each one, in chunks so that long arrays stay cheap."""

    def add(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def totals(values: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")),
            lambda c: add(F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK))),
        )
        start = F.array(F.lit(0))
        return F.aggregate(chunks, start, lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def inside(values: Column, i: Column) -> Column:
        first = (F.floor(i / _CHUNK) * _CHUNK).cast("int")
        return add(F.slice(values, first + 1, i - first))

    return let(sizes, lambda v: let(
        totals(v), lambda t: F.transform(v, lambda _, i: F.get(t, F.floor(i / _CHUNK).cast("int")) + inside(v, i))
    ))


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """The leftmost non-overlapping matches as (start, end, match, before), in code points; those
    that ``keep`` refuses are left out.  ``before`` is the text since the previous match.

    The pattern must not match nothing, and is used from a match's end or from the beginning.
    """
    expression = F.lit(pattern)

    def placed(matches: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        return let(pieces, lambda parts: let(
            _running(F.zip_with(parts, matches, lambda p, m: F.length(p) + F.length(m))),
            lambda starts: F.transform(matches, lambda m, i: F.struct(
                (F.get(starts, i) + F.length(F.get(parts, i))).alias("start"),
                (F.get(starts, i) + F.length(F.get(parts, i)) + F.length(m)).alias("end"),
                m.alias("match"), F.get(parts, i).alias("before"),
            )),
        ))

    none = F.array().cast(f"array<{SPAN}>")
    found = let(
        F.regexp_extract_all(text, expression, F.lit(0)),
        lambda matches: F.when(F.size(matches) > 0, placed(matches)).otherwise(none),
    )
    return found if keep is None else F.filter(found, lambda x: keep(x["match"]))


def labelled(found: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(found, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))
