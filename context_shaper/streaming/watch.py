"""Live view of growing conversations: a status row per growth, each finding once.

Input streams are measured messages (narrow rows, no text).  Row-level findings need no state.
Repeats are keyed by (conversation, text hash) and totals by conversation, so state for a busy
conversation is spread over its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from context_shaper import fixed_values as V
from context_shaper.functions import models as M
from context_shaper.functions.display import (
    fill_template,
    format_tokens,
    format_usd,
    round_half_up,
    to_fixed,
)
from context_shaper.operators.findings import (
    Thresholds,
    base64_blobs,
    large_tool_results,
)

_PARTIAL = "conv_id string, model string, messages bigint, tokens bigint, turns bigint"
_STATUS = (
    "conv_id string, model string, total_tokens bigint, delta bigint, message_count bigint, turn_count bigint"
)
HISTORY_CHUNK = 4096
_REPEAT = "conv_id string, first_index bigint, msg_index bigint, tokens bigint"


def plain_strings(frame: pd.DataFrame, *names: str) -> pd.DataFrame:
    """String columns as Python objects: output frames are put together before Arrow sees them,
    and joined Arrow-backed strings would arrive in several chunks."""
    return frame.assign(**{name: frame[name].astype(object) for name in names})


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum one Arrow batch per conversation, so few rows per conversation are shuffled."""
    for frame in frames:
        yield frame.groupby("conv_id", as_index=False, sort=False).agg(
            model=("model", "last"), messages=("tokens", "size"),
            tokens=("tokens", "sum"), turns=("is_turn", "sum"),
        )


class TotalsProcessor(StatefulProcessor):
    """Running totals per conversation; one status row per trigger that brought messages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("totals", "tokens bigint, messages bigint, turns bigint, model string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, messages, turns, model = self._state.get() if self._state.exists() else (0, 0, 0, None)
        before = tokens
        for part in rows:
            tokens += int(part["tokens"].sum())
            messages += int(part["messages"].sum())
            turns += int(part["turns"].sum())
            named = part["model"].dropna()
            model = named.iloc[-1] if len(named) else model
        self._state.update((tokens, messages, turns, model))
        status = pd.DataFrame({
            "conv_id": [key[0]], "model": [model], "total_tokens": [tokens],
            "delta": [tokens - before], "message_count": [messages], "turn_count": [turns],
        })
        yield plain_strings(status, "conv_id", "model")

    def close(self) -> None:
        pass


class RepeatsProcessor(StatefulProcessor):
    """First position per (conversation, text hash); every later copy is emitted once.

    What was emitted stays: a text that arrives in a later trigger than a copy of it with a greater index
    is reported as the copy, where a batch over all messages reports the other one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first", "msg_index bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Two numbers per message; the smallest index of the first trigger is the first copy.
        copies = [(frame["msg_index"].to_numpy(), frame["tokens"].to_numpy()) for frame in rows]
        if self._first.exists():
            first = self._first.get()[0]
        else:
            first = min(int(indexes.min()) for indexes, _ in copies)
            self._first.update((first,))
        for indexes, tokens in copies:
            later = indexes != first
            if not later.any():
                continue  # most texts have no copy, and a frame takes longer than the state
            repeats = pd.DataFrame({"msg_index": indexes[later], "tokens": tokens[later]})
            repeats.insert(0, "first_index", first)
            repeats.insert(0, "conv_id", key[0])
            yield plain_strings(repeats, "conv_id")

    def close(self) -> None:
        pass


def _chunks(size: int):
    """Messages of one Arrow batch as a row per (conversation, chunk of positions), sizes packed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [
                (conv, int(chunk), int(part["is_turn"].sum()), _packed(part["pos"].to_numpy() % size, part["tokens"].to_numpy()))
                for (conv, chunk), part in frame.groupby(["conv_id", frame["pos"] // size], sort=False)
            ]
            yield pd.DataFrame(found, columns=["conv_id", "chunk", "turns", "sizes"])

    return run


def _packed(places: np.ndarray, tokens: np.ndarray) -> bytes:
    """Places in a chunk and token counts, eight bytes a message."""
    if len(tokens) and tokens.max() >= 1 << 32:
        raise ValueError("a message of 2**32 tokens and more")
    return np.stack([places.astype(np.uint32), tokens.astype(np.uint32)], axis=1).tobytes()


def _unpacked(sizes: bytes) -> np.ndarray:
    return np.frombuffer(sizes, np.uint32).reshape(-1, 2).astype(np.int64)


class HistoryProcessor(StatefulProcessor):
    """Reports a conversation once, in the trigger in which its turns exceed the limit.

    Keys have two levels: the conversation, and inside it chunks of positions.  A trigger reads and writes
    the chunks it has messages of; a chunk is one entry of eight bytes a message.  The report adds
    the chunks' sums up to the middle and opens the one chunk that the middle is in.  State goes
    when a conversation is reported, so it holds conversations of few turns only.
    """

    def __init__(self, turns: int) -> None:
        self._limit = turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._progress = handle.getValueState("progress", "turns bigint, reported boolean")
        self._sums = handle.getMapState("sums", "chunk bigint", "messages bigint, tokens bigint")
        self._sizes = handle.getMapState("sizes", "chunk bigint", "packed binary")

    def _add(self, chunk: int, sizes: bytes) -> None:
        messages, tokens = self._sums.getValue((chunk,)) if self._sums.containsKey((chunk,)) else (0, 0)
        before = bytes(self._sizes.getValue((chunk,))[0]) if messages else b""
        added = _unpacked(sizes)
        self._sums.updateValue((chunk,), (int(messages) + len(added), int(tokens) + int(added[:, 1].sum())))
        self._sizes.updateValue((chunk,), (before + sizes,))

    def _older(self) -> int:
        """Tokens of the first half of the messages, by position."""
        sums = sorted((key[0], *map(int, value)) for key, value in self._sums.iterator())
        left, older = sum(messages for _, messages, _ in sums) // 2, 0
        for chunk, messages, tokens in sums:
            if messages > left:
                sizes = _unpacked(bytes(self._sizes.getValue((chunk,))[0]))
                return older + int(sizes[np.argsort(sizes[:, 0], kind="stable")[:left], 1].sum())
            left, older = left - messages, older + tokens
        return older

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, reported = self._progress.get() if self._progress.exists() else (0, False)
        arrived: dict[int, list[bytes]] = {}
        for part in rows if not reported else ():
            turns += int(part["turns"].sum())
            for chunk, sizes in zip(part["chunk"], part["sizes"], strict=True):
                arrived.setdefault(int(chunk), []).append(bytes(sizes))
        for chunk, sizes in arrived.items():
            self._add(chunk, b"".join(sizes))
        found = not reported and turns > self._limit
        older = self._older() if found else 0
        if found:
            self._sums.clear()
            self._sizes.clear()
        self._progress.update((turns, bool(reported or found)))
        count = 1 if found else 0
        report = pd.DataFrame({
            "conv_id": [key[0]] * count, "turn_count": [turns] * count, "older_tokens": [older] * count,
        })
        yield plain_strings(report, "conv_id")

    def close(self) -> None:
        pass


def watch_long_histories(
    measured: DataFrame, limits: Thresholds = Thresholds(), chunk_rows: int = HISTORY_CHUNK
) -> DataFrame:
    """Long-history findings, each conversation once, with the savings at that moment."""
    narrow = measured.select(
        "conv_id", "pos", "tokens", F.col("kind").isin("user", "assistant").cast("int").alias("is_turn")
    )
    chunked = narrow.mapInPandas(_chunks(chunk_rows), "conv_id string, chunk bigint, turns bigint, sizes binary")
    found = chunked.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=HistoryProcessor(limits.long_history_turns),
        outputStructType="conv_id string, turn_count bigint, older_tokens bigint",
        outputMode="Append", timeMode="None",
    )
    return found.select(
        "conv_id", F.lit("long_history").alias("finding"), F.lit("warn").alias("severity"),
        round_half_up(F.col("older_tokens").cast("double") * F.lit(V.LONG_HISTORY_RECOVERY)).alias("est_savings"),
        fill_template(
            V.FINDING_MESSAGES["long_history"], F.col("turn_count"), F.col("older_tokens")
        ).alias("message"),
        F.array().cast("array<bigint>").alias("messages"),
    )


def watch_status(measured: DataFrame, model: str | None = None) -> DataFrame:
    """Status rows: total, delta, window use, cost per message and message count."""
    narrow = measured.select(
        "conv_id", "model", "tokens", F.col("kind").isin("user", "assistant").cast("int").alias("is_turn")
    )
    status = narrow.mapInPandas(_combine, _PARTIAL).groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=TotalsProcessor(), outputStructType=_STATUS, outputMode="Append", timeMode="None"
    )
    chosen = F.lit(model) if model else F.col("model")
    window = M.context_window(F.col("model"))
    tokens = F.col("total_tokens")
    rows = status.withColumn("model", chosen).withColumn(
        "usage_pct", tokens.cast("double") / window.cast("double") * F.lit(100.0)
    ).withColumn("per_call_usd", M.input_cost_usd(tokens, M.input_price(F.col("model"))))
    sign = F.when(F.col("delta") > 0, "+").otherwise("-")
    change = F.when(
        F.col("delta") != 0,
        F.concat(F.lit(" ("), sign, format_tokens(F.abs("delta")), F.lit(")")),
    ).otherwise("")
    usage = F.coalesce(F.concat(F.lit(" · "), to_fixed(F.col("usage_pct"), 1), F.lit("% of window")), F.lit(""))
    cost = F.coalesce(F.concat(F.lit(" · "), format_usd(F.col("per_call_usd")), F.lit("/msg")), F.lit(""))
    return rows.withColumn(
        "line",
        fill_template(
            "~%s tokens%s%s%s · %s messages", format_tokens(tokens), change, usage, cost, F.col("message_count")
        ),
    )


def watch_row_findings(measured: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Findings that depend on one message only; stateless."""
    return large_tool_results(measured, limits).unionByName(base64_blobs(measured))


def watch_repeats(measured: DataFrame) -> DataFrame:
    """Duplicate findings; a message is reported when it arrives, so each one once."""
    keyed = measured.filter(F.col("content_key").isNotNull()).select(
        "conv_id", "content_key", "msg_index", "tokens"
    )
    repeats = keyed.groupBy("conv_id", "content_key").transformWithStateInPandas(
        statefulProcessor=RepeatsProcessor(), outputStructType=_REPEAT, outputMode="Append", timeMode="None"
    )
    return repeats.select(
        "conv_id", F.lit("duplicate_content").alias("finding"), F.lit("warn").alias("severity"),
        (F.col("tokens") - V.MESSAGE_OVERHEAD_TOKENS).alias("est_savings"),
        fill_template(
            V.FINDING_MESSAGES["duplicate_content"], F.col("msg_index"), F.col("first_index"), F.col("tokens")
        ).alias("message"),
        F.array("first_index", "msg_index").alias("messages"),
    )
