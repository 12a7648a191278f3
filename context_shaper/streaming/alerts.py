"""The alert decision as a keyed stateful stream: per session, or per owner with a bounded number of sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from context_shaper.operators.alerts import (
    DECISION_SCHEMA,
    OWNED_COLUMNS,
    OWNED_SCHEMA,
    AlertOptions,
    OwnedSessions,
    candidates,
)
from context_shaper.sources.ledger import check_entries
from context_shaper.sources.ledger_store import LedgerStore
from context_shaper.streaming.watch import plain_strings

_STATE_SCHEMA = "t bigint, b bigint"


class RegrowthProcessor(StatefulProcessor):
    """Keeps (t, b) per session and emits the events that were checked deeply."""

    def __init__(self, options: AlertOptions, ttl_ms: int | None) -> None:
        self._options, self._ttl_ms = options, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("growth", _STATE_SCHEMA, ttlDurationMs=self._ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self._state.update((int(row["t"]), int(row["b"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A trigger's rows may come in several frames; order holds over all of them.
        events = pd.concat(list(rows)).sort_values(["ts", "bytes", "tokens"])
        tokens_warned, bytes_checked = self._state.get() if self._state.exists() else (0, 0)
        factor, threshold = self._options.regrowth, self._options.warn_tokens
        found = []
        for ts, size, tokens in zip(events["ts"], events["bytes"], events["tokens"], strict=True):
            if bytes_checked > 0 and size < bytes_checked * factor:
                continue
            warn = bool(tokens >= threshold and tokens >= tokens_warned * factor)
            tokens_warned, bytes_checked = (int(tokens) if warn else tokens_warned), int(size)
            found.append((key[0], int(ts), int(size), int(tokens), True, warn))
        self._state.update((tokens_warned, bytes_checked))
        columns = ["session_id", "ts", "bytes", "tokens", "deep_check", "warn"]
        yield plain_strings(pd.DataFrame(found, columns=columns), "session_id")

    def close(self) -> None:
        pass


def deep_check_stream(
    events: DataFrame,
    options: AlertOptions = AlertOptions(),
    ttl_ms: int | None = None,
    initial_state: DataFrame | None = None,
) -> DataFrame:
    """Stream of (session_id, ts, bytes, tokens) -> stream of deep checks with ``warn``.

    Small transcripts are dropped before the shuffle.  ``ttl_ms`` forgets idle sessions;
    ``initial_state`` (session_id, t, b) carries state over from elsewhere.
    """
    return candidates(events, options).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=RegrowthProcessor(options, ttl_ms),
        outputStructType=DECISION_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
        initialState=None if initial_state is None else initial_state.groupBy("session_id"),
    )


class OwnedProcessor(StatefulProcessor):
    """Keeps (t, b, touched) for the sessions an owner touched last.

    Everything an owner has is one entry per session, ``keep`` at most: they are read and written once
    a trigger.  Entries carried over from earlier versions come in as initial state.
    """

    def __init__(self, options: AlertOptions, keep: int, ttl_ms: int | None) -> None:
        self._options, self._keep, self._ttl_ms = options, keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getMapState(
            "sessions", "session_id string", "t bigint, b bigint, touched bigint", ttlDurationMs=self._ttl_ms
        )

    def _store(self, sessions: OwnedSessions, before: dict) -> None:
        for gone in before.keys() - sessions.entries.keys():
            self._state.removeKey((gone,))
        for session, entry in sessions.entries.items():
            if before.get(session) != entry:
                self._state.updateValue((session,), entry)

    def _load(self) -> dict:
        if not self._state.exists():
            return {}
        return {key[0]: tuple(int(x) for x in entry) for key, entry in self._state.iterator()}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        before = self._load()
        sessions = OwnedSessions(self._options, self._keep, dict(before))
        for row in initialState.itertuples():
            sessions.carry_over(row.session_id, int(row.t), int(row.b), int(row.touched))
        self._store(sessions, before)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A trigger's rows may come in several frames; order holds over all of them.
        events = pd.concat(list(rows)).sort_values(["ts", "session_id", "bytes", "tokens"])
        before = self._load()
        sessions = OwnedSessions(self._options, self._keep, dict(before))
        found = [
            (key[0], *check)
            for event in zip(events["session_id"], events["ts"], events["bytes"], events["tokens"], strict=True)
            for check in sessions.see(*event)
        ]
        self._store(sessions, before)
        yield plain_strings(pd.DataFrame(found, columns=OWNED_COLUMNS), "owner", "session_id")

    def close(self) -> None:
        pass


def owned_check_stream(
    events: DataFrame,
    options: AlertOptions = AlertOptions(),
    keep: int | None = None,
    ttl_ms: int | None = None,
    initial_state: DataFrame | None = None,
) -> DataFrame:
    """Stream of (owner, session_id, ts, bytes, tokens) -> deep checks, forgetting all but an owner's last sessions.

    ``initial_state`` (owner, session_id, t, b, touched) carries saved state over; ``ttl_ms`` also forgets
    sessions that were idle for so long.
    """
    rows = candidates(events, options, ["owner"])
    return rows.groupBy("owner").transformWithStateInPandas(
        statefulProcessor=OwnedProcessor(options, keep or options.state_sessions, ttl_ms),
        outputStructType=OWNED_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
        initialState=None if initial_state is None else initial_state.groupBy("owner"),
    )


def ledger_sink(
    checks: DataFrame, store: LedgerStore, writer: str, results_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write deep checks, and their ledger lines into ``store``, from within the stream.

    Both sinks go by the batch number: a batch that is run again replaces its results by the same rows, and
    the ledger, which takes a part of a writer once, stays as it is.  ``writer`` names the stream and must stay
    the same over restarts.  The ledger lines are made from the written results, so state is advanced once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        folder = f"{results_path}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        written = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        store.append(check_entries(written), writer, batch_id)

    return (
        checks.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
