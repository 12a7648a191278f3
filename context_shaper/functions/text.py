"""Column functions over message text: length, tokens, identity, previews and blobs.

All of them are built-in Spark expressions.  Lengths and cuts count UTF-16 units.
"""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from context_shaper import fixed_values as V
from context_shaper.functions.display import fill_template


def _char_class(characters: str, negate: bool = False) -> str:
    """A regex class that lists its characters one by one (faster to match than ranges)."""
    escaped = "".join("\\" + c if c in r"[]\^-&" else c for c in characters)
    return f"[{'^' if negate else ''}{escaped}]"


_SYMBOL = _char_class(V.SYMBOL_CHARACTERS)
_BLOB_CHAR = _char_class(V.BLOB_CHARACTERS)
_WHITESPACE_RUN = rf"[\s{V.UNICODE_WHITESPACE_CLASS}]+"
# A run can only start where the previous character is outside the class, so the look-behind
# keeps the scan linear; possessive quantifiers keep it from backtracking.
_BLOB_RUN = rf"(?<!{_BLOB_CHAR}){_BLOB_CHAR}{{{V.BLOB_RUN_CHARS},}}+"
_BLOB_REPLACE = (
    rf"{V.DATA_URI_PATTERN}{_BLOB_CHAR}{{{V.BLOB_RUN_CHARS},}}+={{0,2}}|{_BLOB_RUN}={{0,2}}"
)


def built_once(build):
    """Keep the expression built for given column names; large ones take long to assemble."""
    kept: dict = {}

    @wraps(build)
    def lookup(*names: str) -> Column:
        key = (SparkContext._jvm, *names)
        if key not in kept:
            kept[key] = build(*names)
        return kept[key]

    return lookup


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, however often that mentions it.

    Nested expressions that mention their input several times would otherwise multiply.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utf16_length(text: Column) -> Column:
    """Number of UTF-16 units; equals the character count unless the text leaves the BMP."""
    wide = F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)
    return (
        F.when(F.octet_length(text) == F.length(text), F.length(text))
        .otherwise(wide)
        .cast("bigint")
    )


def utf16_prefix(text: Column, units: int) -> Column:
    """First ``units`` UTF-16 units; half of a split surrogate pair becomes U+FFFD."""
    encoded = F.substring(F.encode(F.substring(text, 1, units), "UTF-16BE"), 1, 2 * units)
    last_unit = F.hex(F.substring(encoded, 2 * units - 1, 2))
    split_pair = last_unit.between("D800", "DBFF")
    whole = F.decode(F.substring(encoded, 1, 2 * (units - 1)), "UTF-16BE")
    wide = F.when(split_pair, F.concat(whole, F.lit("\ufffd"))).otherwise(
        F.decode(encoded, "UTF-16BE")
    )
    head = F.substring(text, 1, units)
    return F.when(utf16_length(head) == F.length(head), head).otherwise(wide)


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_SYMBOL)).cast("bigint")


def symbol_density(text: Column) -> Column:
    """Share of code-like characters; 0 for empty text."""
    size = utf16_length(text)
    return F.when(size > 0, symbol_count(text) / size).otherwise(F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    """Token estimate: characters over 4, or over 3.2 when symbols are dense."""
    size = utf16_length(text)
    rate = F.when(
        symbol_count(text) / size > F.lit(V.DENSE_SYMBOL_SHARE), F.lit(V.CHARS_PER_TOKEN_DENSE)
    ).otherwise(F.lit(V.CHARS_PER_TOKEN_PROSE))
    return F.when(F.octet_length(text) > 0, F.ceil(size / rate)).otherwise(F.lit(0)).cast("bigint")


def collapse_whitespace(text: Column) -> Column:
    """Every whitespace run becomes one space.

    Text that has nothing to collapse is found by two cheap searches and passed on.  Otherwise
    plain replacements handle ASCII whitespace; the regex over the full whitespace class runs
    just for text that can hold other whitespace characters.
    """
    spaced = text
    for character in V.ASCII_WHITESPACE[1:]:
        spaced = F.replace(spaced, F.lit(character), F.lit(" "))
    collapsed = bind(
        spaced,
        lambda value: F.when(
            F.contains(value, F.lit("  ")), F.regexp_replace(value, " {2,}", " ")
        ).otherwise(value),
    )
    nothing_to_do = ~(text.rlike(f"[{V.ASCII_WHITESPACE[1:]}]") | F.contains(text, F.lit("  ")))
    ascii_only = F.when(nothing_to_do, text).otherwise(collapsed)
    raw = text.cast("binary")
    other_whitespace = F.lit(False)
    for prefix in V.UNICODE_WHITESPACE_BYTES:
        other_whitespace = other_whitespace | F.contains(raw, F.unhex(F.lit(prefix)))
    return F.when(
        (F.octet_length(text) > F.length(text)) & other_whitespace,
        F.regexp_replace(text, _WHITESPACE_RUN, " "),
    ).otherwise(ascii_only)


def normalized_text(text: Column) -> Column:
    return F.trim(collapse_whitespace(text))


def content_hash(text: Column) -> Column:
    """SHA-1 of the text with whitespace collapsed and trimmed."""
    return F.sha1(normalized_text(text).cast("binary"))


def preview(text: Column, units: int = V.PREVIEW_CHARS) -> Column:
    return bind(
        collapsed_head(text, units, trim=True),
        lambda clean: F.when(
            utf16_length(clean) > units, F.concat(utf16_prefix(clean, units), F.lit("…"))
        ).otherwise(clean),
    )


def collapsed_head(text: Column, units: int, trim: bool) -> Column:
    """The collapsed text, or a head of it that is certain to hold more than ``units`` characters.

    A head is enough unless whitespace runs shorten it; only then is the whole text collapsed.
    """

    def clean(part: Column) -> Column:
        return normalized_text(part) if trim else collapse_whitespace(part)

    return F.when(F.length(text) <= 8 * units, clean(text)).otherwise(
        bind(
            clean(F.substring(text, 1, 8 * units)),
            lambda head: F.when(F.length(head) > units + 1, head).otherwise(clean(text)),
        )
    )


def _has_blob_run(text: Column) -> Column:
    return (F.octet_length(text) >= V.BLOB_RUN_CHARS) & text.rlike(_BLOB_RUN)


def has_blob(text: Column) -> Column:
    """Detector's test: a base64 data URI of any size, or a long unbroken base64 run."""
    data_uri = F.contains(text, F.lit(V.DATA_URI_HINT)) & text.rlike(V.DATA_URI_PATTERN)
    return data_uri | _has_blob_run(text)


def has_strippable_blob(text: Column) -> Column:
    """Rewriter's test: a long run is required, a data URI prefix is not enough."""
    return _has_blob_run(text) | (
        F.contains(text, F.lit(V.DATA_URI_HINT)) & text.rlike(_BLOB_REPLACE)
    )


def strip_blobs(text: Column, marker_name: str = V.MARKER_NAME) -> Column:
    marker = V.BLOB_MARKER % marker_name
    literal = marker.replace("\\", r"\\").replace("$", r"\$")
    return F.regexp_replace(text, F.lit(_BLOB_REPLACE), F.lit(literal))


def truncate_to_tokens(text: Column, max_tokens: int, marker_name: str = V.MARKER_NAME) -> Column:
    """Keep ``4 * max_tokens`` characters and say how many were left out."""
    keep = 4 * max_tokens
    size = utf16_length(text)
    marker = fill_template(V.TRIM_MARKER, F.lit(marker_name), size - keep)
    return F.when(size > keep, F.concat(utf16_prefix(text, keep), marker)).otherwise(text)
