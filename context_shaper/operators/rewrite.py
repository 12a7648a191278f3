"""Rewriting strategies: strip blobs, drop repeats, trim stale tool results, prune history.

Each strategy sees the text left by the one before.  What a message becomes depends on other
messages in three ways only: whether it repeats an earlier one, whether it is among the last
few, and where the kept tail begins.  Those decisions are made on a narrow table; the texts
then meet the (few) decisions in one join with unique keys, and everything else is row-local.
When only figures are wanted, that join carries no text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from context_shaper import fixed_values as V
from context_shaper.functions import text as T
from context_shaper.functions.display import fill_template, format_tokens, percent_of
from context_shaper.operators.ordering import (
    CHUNK_ROWS,
    chunk_of,
    compute_once,
    join_conversations,
    last_rows,
    members_of_repeated_groups,
    union_all,
)


@dataclass(frozen=True)
class RewriteOptions:
    """``None`` means the default.  Counts must be positive whole numbers."""

    strategies: tuple[str, ...] | None = None
    keep_recent: int | None = None
    max_tool_result_tokens: int | None = None
    marker_name: str = V.MARKER_NAME
    duplicate_min_chars: int = V.DUPLICATE_MIN_CHARS
    strip_min_saving: int = V.STRIP_MIN_SAVING
    chunk_rows: int = CHUNK_ROWS

    def __post_init__(self) -> None:
        defaults = {
            "strategies": V.DEFAULT_STRATEGIES,
            "keep_recent": V.KEEP_RECENT,
            "max_tool_result_tokens": V.MAX_TOOL_RESULT_TOKENS,
        }
        for name, default in defaults.items():
            if getattr(self, name) is None:
                object.__setattr__(self, name, default)
        unknown = set(self.strategies) - set(V.STRATEGIES)
        if unknown:
            raise ValueError(f"unknown strategies: {sorted(unknown)}")
        for name in ("keep_recent", "max_tool_result_tokens"):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < 1:
                raise ValueError(f"{name} must be a positive whole number, not {value!r}")

    def runs(self, strategy: str) -> bool:
        return strategy in self.strategies


def _framed(text: Column) -> Column:
    """The rewriter's reading of a message after ``text`` was placed into it."""
    return F.concat(F.col("frame_prefix"), text, F.col("frame_suffix"))


def prepare(messages: DataFrame, options: RewriteOptions = RewriteOptions()) -> DataFrame:
    """Row-local part: the stripped text, its figures, and what trimming would leave.

    Raw-text conversations and external system prompts are not rewritten.
    """
    name, limit = options.marker_name, options.max_tool_result_tokens
    rows = messages.filter((F.col("doc_format") != "text") & (F.col("msg_index") >= 0)).select(
        "conv_id", F.col("msg_index").alias("idx"), "model", "role", "given_role",
        "is_tool_result", "content_is_list", "frame_prefix", "frame_suffix",
        F.col("opt_text").alias("text_0"),
    )
    keys = ["conv_id", "idx", "model"]
    carried = {
        column: F.col(column)
        for column in ("role", "given_role", "is_tool_result", "content_is_list",
                       "frame_prefix", "frame_suffix")
    }
    original = F.col("text_0")
    stripped = (
        F.when(T.has_strippable_blob(original), T.strip_blobs(original, name))
        if options.runs("strip-base64")
        else F.lit(None).cast("string")
    )
    rows = compute_once(
        rows, keys,
        carried | {"text_0": original, "tokens_before": T.estimate_tokens(original), "cleaned": stripped},
    )
    saved = F.col("tokens_before") - T.estimate_tokens(F.col("cleaned"))
    carried["tokens_before"] = F.col("tokens_before")
    rows = compute_once(
        rows, keys,
        carried | {
            "text_0": original,
            "cleaned": F.col("cleaned"),
            "strip_saved": F.when(
                F.col("cleaned").isNotNull() & (saved > options.strip_min_saving), saved
            ),
        },
    )
    stripped_out = F.col("strip_saved").isNotNull()
    carried["strip_saved"] = F.col("strip_saved")
    text_1 = F.when(stripped_out, _framed(F.col("cleaned"))).otherwise(original)
    rows = compute_once(
        rows, keys,
        carried | {"stripped": F.when(stripped_out, F.col("cleaned")), "text_1": text_1},
    )
    text_1 = F.col("text_1")
    carried |= {"stripped": F.col("stripped"), "text_1": text_1}
    key = F.when(
        T.utf16_length(text_1) >= options.duplicate_min_chars, T.content_hash(text_1)
    ) if options.runs("dedupe") else F.lit(None).cast("string")
    rows = compute_once(
        rows, keys,
        carried | {
            "tokens_1": F.when(F.col("strip_saved").isNotNull(), T.estimate_tokens(text_1))
            .otherwise(F.col("tokens_before")),
            "content_key": key,
        },
    )
    carried |= {"tokens_1": F.col("tokens_1"), "content_key": F.col("content_key")}
    too_long = F.col("is_tool_result") & (F.col("tokens_1") > limit)
    if not options.runs("trim-tool-results"):
        too_long = F.lit(False)
    trimmed = F.when(too_long, T.truncate_to_tokens(text_1, limit, name))
    rows = compute_once(rows, keys, carried | {"too_long": too_long, "trimmed": trimmed})
    trimmed = F.col("trimmed")
    return compute_once(
        rows, keys,
        carried | {
            "too_long": F.col("too_long"),
            "trim_saved_1": F.col("tokens_1") - T.estimate_tokens(trimmed),
            "tokens_if_trimmed": F.when(
                trimmed.isNotNull(), T.bind(_framed(trimmed), T.estimate_tokens)
            ),
        },
    ).withColumn("trim_saved_1", F.when(F.col("too_long"), F.col("trim_saved_1")))


def figures_only(prepared: DataFrame) -> DataFrame:
    """The prepared rows without their texts: numbers, a hash, and the (short) frames."""
    return prepared.drop("text_1", "stripped")


def decide(prepared: DataFrame, options: RewriteOptions = RewriteOptions()) -> DataFrame:
    """decisions(conv_id, idx, first_idx, stale) for messages that depend on other messages."""
    narrow = prepared.select("conv_id", "idx", "content_key", "is_tool_result", "too_long")
    parts = []
    if options.runs("dedupe"):
        members = members_of_repeated_groups(
            narrow.filter(F.col("content_key").isNotNull()).drop("too_long"),
            ["conv_id", "content_key"], "idx", options.chunk_rows,
        )
        parts.append(
            members.filter(F.col("idx") > F.col("first_position")).select(
                "conv_id", "idx", F.col("first_position").alias("first_idx"), "is_tool_result"
            )
        )
    if options.runs("trim-tool-results"):
        parts.append(
            narrow.filter("too_long").select(
                "conv_id", "idx", F.lit(None).cast("bigint").alias("first_idx"), "is_tool_result"
            )
        )
    if not parts:
        return narrow.filter(F.lit(False)).select(
            "conv_id", "idx", F.lit(None).cast("bigint").alias("first_idx"), F.lit(False).alias("stale")
        )
    found = union_all(parts).groupBy("conv_id", "idx").agg(
        F.max("first_idx").alias("first_idx"), F.max("is_tool_result").alias("is_tool_result")
    )
    tail = last_rows(narrow.select("conv_id", "idx"), "conv_id", "idx", options.keep_recent)
    recent = tail.withColumn("recent", F.lit(True))
    may_trim = F.lit(options.runs("trim-tool-results"))
    return found.join(recent, ["conv_id", "idx"], "left").select(
        "conv_id", "idx", "first_idx",
        (may_trim & F.col("is_tool_result") & F.col("recent").isNull()).alias("stale"),
    ).filter(F.col("first_idx").isNotNull() | F.col("stale"))


def apply_decisions(
    prepared: DataFrame, decisions: DataFrame, options: RewriteOptions = RewriteOptions()
) -> DataFrame:
    """rewritten: one row per message with its text and figures after the first three steps.

    ``placed`` is the text written into the message (null when untouched) and ``text`` the
    message as the rewriter reads it afterwards.  From ``figures_only`` rows the same figures
    come out, without texts.
    """
    for column in ("text_1", "stripped"):
        if column not in prepared.columns:
            prepared = prepared.withColumn(column, F.lit(None).cast("string"))
    rows = prepared.join(decisions, ["conv_id", "idx"], "left")
    repeat, stale = F.col("first_idx").isNotNull(), F.coalesce("stale", F.lit(False))
    limit = options.max_tool_result_tokens
    stub = F.when(
        repeat,
        fill_template(V.DUPLICATE_MARKER, F.lit(options.marker_name), F.col("first_idx")),
    )
    passed = [column for column in rows.columns if column not in ("first_idx", "stale")]
    passed = {column: F.col(column) for column in passed} | {
        "first_idx": F.col("first_idx"), "stale": stale, "stub": stub,
    }
    rows = rows.select(*[value.alias(column) for column, value in passed.items()])
    stub_text = _framed(F.col("stub"))
    rows = rows.withColumn("stub_tokens", F.when(repeat, T.bind(stub_text, T.estimate_tokens)))
    # A repeat that is a stale tool result is trimmed again if its stub exceeds the limit.
    trim_stub = repeat & F.col("stale") & (F.col("stub_tokens") > limit)
    trimmed_stub = F.when(
        trim_stub,
        T.bind(stub_text, lambda text: T.truncate_to_tokens(text, limit, options.marker_name)),
    )
    rows = rows.withColumn("trimmed_stub", trimmed_stub)
    trim_text = ~repeat & F.col("stale") & F.col("too_long")
    trim_stub, trimmed_stub = F.col("trimmed_stub").isNotNull(), F.col("trimmed_stub")
    # Recomputed from the text that is carried anyway, so the trimmed copy is not shuffled.
    trimmed_text = F.when(
        trim_text, T.truncate_to_tokens(F.col("text_1"), limit, options.marker_name)
    )
    placed = F.coalesce(trimmed_stub, F.col("stub"), trimmed_text, F.col("stripped"))
    changed = repeat | trim_text | F.col("strip_saved").isNotNull()
    return rows.select(
        "conv_id", "idx", "role", "given_role", "model", "is_tool_result", "content_is_list",
        F.when(changed, _framed(placed)).otherwise(F.col("text_1")).alias("text"),
        placed.alias("placed"),
        changed.alias("changed"),
        "tokens_before",
        F.when(trim_stub, T.bind(_framed(trimmed_stub), T.estimate_tokens))
        .when(repeat, F.col("stub_tokens"))
        .when(trim_text, F.col("tokens_if_trimmed"))
        .otherwise(F.col("tokens_1"))
        .alias("tokens_after"),
        "strip_saved",
        F.col("first_idx").alias("repeat_of"),
        F.when(repeat, F.col("tokens_1")).alias("dedupe_saved"),
        F.when(trim_stub, F.col("stub_tokens") - T.estimate_tokens(trimmed_stub))
        .when(trim_text, F.col("trim_saved_1"))
        .alias("trim_saved"),
    )


def prune_points(rewritten: DataFrame, options: RewriteOptions = RewriteOptions()) -> DataFrame:
    """prune(conv_id, message_count, keep_from, pruned_tokens, stub, stub_tokens).

    Only conversations that get pruned.  The boundary is found in the last ``keep_recent``
    rows, and pruned tokens are all tokens less those of the kept rows.
    """
    keep = options.keep_recent
    narrow = rewritten.select("conv_id", "idx", "is_tool_result", "tokens_after")
    tail = last_rows(narrow, "conv_id", "idx", keep)
    bounds = tail.groupBy("conv_id").agg(
        (F.max("idx") + 1).alias("message_count"),
        F.min(F.when(~F.col("is_tool_result"), F.col("idx"))).alias("keep_from"),
        F.collect_list(F.struct("idx", "tokens_after")).alias("tail"),
    ).filter(
        (F.col("message_count") > 2 * keep) & (F.col("message_count") - F.col("keep_from") >= 2)
    )
    kept = F.aggregate(
        F.filter("tail", lambda row: row["idx"] >= F.col("keep_from")),
        F.lit(0).cast("bigint"),
        lambda total, row: total + row["tokens_after"],
    )
    totals = narrow.groupBy("conv_id").agg(F.sum("tokens_after").alias("all_tokens"))
    rows = bounds.withColumn("kept_tokens", kept).join(totals, "conv_id")
    rows = rows.withColumn("pruned_tokens", F.col("all_tokens") - F.col("kept_tokens"))
    stub = fill_template(
        V.PRUNE_MARKER, F.lit(options.marker_name), F.col("keep_from"), F.col("pruned_tokens")
    )
    return rows.select(
        "conv_id", "message_count", "keep_from", "pruned_tokens", stub.alias("stub"),
        T.estimate_tokens(stub).alias("stub_tokens"),
    )


def prune(
    rewritten: DataFrame, points: DataFrame, options: RewriteOptions = RewriteOptions()
) -> DataFrame:
    """Replace the pruned head of each conversation by one user message.

    ``out_idx`` is the position in the result; ``idx`` stays the original one (null for stubs).
    """
    marked = join_conversations(
        rewritten, points.select("conv_id", "message_count", "keep_from"), "message_count", "idx",
        "left", options.chunk_rows,
    )
    keep_from = F.col("keep_from")
    kept = marked.filter(keep_from.isNull() | (F.col("idx") >= keep_from)).select(
        "conv_id",
        F.when(keep_from.isNull(), F.col("idx")).otherwise(F.col("idx") - keep_from + 1).alias("out_idx"),
        "idx", "role", "text", "placed", "changed", "tokens_after",
    )
    stubs = points.select(
        "conv_id", F.lit(0).cast("bigint").alias("out_idx"), F.lit(None).cast("bigint").alias("idx"),
        F.lit("user").alias("role"), F.col("stub").alias("text"), F.col("stub").alias("placed"),
        F.lit(True).alias("changed"), F.col("stub_tokens").alias("tokens_after"),
    )
    return kept.unionByName(stubs)


def digest_lines(
    rewritten: DataFrame, points: DataFrame, options: RewriteOptions = RewriteOptions()
) -> DataFrame:
    """One short line per pruned message: conv_id, idx, line."""
    clean = T.bind(
        T.collapsed_head(F.col("text"), V.DIGEST_CHARS, trim=False),
        lambda text: T.utf16_prefix(text, V.DIGEST_CHARS),
    )
    short = rewritten.select(
        "conv_id", "idx",
        F.concat(
            F.lit("["), F.col("idx").cast("string"), F.lit(":"),
            F.coalesce("given_role", F.lit("undefined")), F.lit("] "),
            clean,
        ).alias("line"),
    )
    facts = points.select("conv_id", "message_count", "keep_from")
    return (
        join_conversations(short, facts, "message_count", "idx", "inner", options.chunk_rows)
        .filter(F.col("idx") < F.col("keep_from"))
        .select("conv_id", "idx", "line")
    )


def prune_digests(
    rewritten: DataFrame, points: DataFrame, options: RewriteOptions = RewriteOptions()
) -> DataFrame:
    """Digest text per conversation and part; a part covers a bounded range of positions."""
    lines = digest_lines(rewritten, points, options).withColumn(
        "part", chunk_of(F.col("idx"), options.chunk_rows)
    )
    ordered = F.array_sort(F.collect_list(F.struct("idx", "line")))
    return (
        lines.groupBy("conv_id", "part")
        .agg(ordered.alias("rows"))
        .select(
            "conv_id", "part",
            F.array_join(F.transform("rows", lambda row: row["line"]), "\n").alias("digest"),
        )
    )


def change_log(rewritten: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """changes(conv_id, strategy_no, strategy, message_index, tokens_saved, note).

    Sort by (conv_id, strategy_no, message_index) for the order of application.
    """

    def rows(strategy: str, frame: DataFrame, saved: Column, index: Column, *values: Column) -> DataFrame:
        return frame.select(
            "conv_id",
            F.lit(V.STRATEGIES.index(strategy) + 1).alias("strategy_no"),
            F.lit(strategy).alias("strategy"),
            index.alias("message_index"),
            saved.cast("bigint").alias("tokens_saved"),
            fill_template(V.CHANGE_NOTES[strategy], *values).alias("note"),
        )

    # One pass: a message contributes up to three changes.
    columns = (("strip-base64", "strip_saved", ()), ("dedupe", "dedupe_saved", (F.col("repeat_of"),)),
               ("trim-tool-results", "trim_saved", ()))
    entries = F.array(*[
        F.struct(
            F.lit(V.STRATEGIES.index(name) + 1).alias("strategy_no"), F.lit(name).alias("strategy"),
            F.col(saved).alias("tokens_saved"), fill_template(V.CHANGE_NOTES[name], *values).alias("note"),
        )
        for name, saved, values in columns
    ])
    log = rewritten.select(
        "conv_id", F.col("idx").alias("message_index"), F.explode(entries).alias("change")
    ).filter(F.col("change.tokens_saved").isNotNull()).select(
        "conv_id", "change.strategy_no", "change.strategy", "message_index",
        "change.tokens_saved", "change.note",
    )
    if points is None:
        return log
    pruned = rows(
        "prune-history", points, F.col("pruned_tokens") - F.col("stub_tokens"),
        F.lit(0).cast("bigint"), F.col("keep_from"),
    )
    return log.unionByName(pruned)


def savings(rewritten: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """savings(conv_id, model, tokens_before, tokens_after, tokens_saved, saved_pct, change_count)."""
    counted = [F.count("strip_saved"), F.count("dedupe_saved"), F.count("trim_saved")]
    # One model per conversation: as a grouping key it keeps the aggregation a hash one.
    rows = rewritten.groupBy("conv_id", "model").agg(
        F.sum("tokens_before").alias("tokens_before"),
        F.sum("tokens_after").alias("tokens_after"),
        (counted[0] + counted[1] + counted[2]).alias("change_count"),
    )
    if points is not None:
        cut = points.select(
            "conv_id", (F.col("pruned_tokens") - F.col("stub_tokens")).alias("cut"), F.lit(1).alias("prunes")
        )
        rows = rows.join(cut, "conv_id", "left").select(
            "conv_id", "model", "tokens_before",
            (F.col("tokens_after") - F.coalesce("cut", F.lit(0))).alias("tokens_after"),
            (F.col("change_count") + F.coalesce("prunes", F.lit(0))).alias("change_count"),
        )
    saved = F.col("tokens_before") - F.col("tokens_after")
    return rows.select(
        "conv_id", "model", "tokens_before", "tokens_after", saved.alias("tokens_saved"),
        percent_of(saved, F.col("tokens_before")).alias("saved_pct"), "change_count",
    )


def savings_line(summary: DataFrame) -> DataFrame:
    """One text line per conversation, as a run would report it."""
    return summary.select(
        "conv_id",
        fill_template(
            "%s → %s tokens (saved ~%s, %s%%) via %s change(s)",
            format_tokens(F.col("tokens_before")), format_tokens(F.col("tokens_after")),
            format_tokens(F.col("tokens_saved")), F.col("saved_pct"), F.col("change_count"),
        ).alias("line"),
    )
