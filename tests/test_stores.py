"""Ledger generations, gated and incremental reading of transcripts, running totals, bounded state."""

import json
import os
import random
from collections import Counter

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from context_shaper.functions import models as M
from context_shaper.operators import alerts as A, impact as I, lookup as K
from context_shaper.operators.measure import measure
from context_shaper.operators.totals import conversation_totals
from context_shaper.plans import requests as Q
from context_shaper.plans.sessions import ProfileTable, check_sessions, report_from_files
from context_shaper.session import new_shared_path
from context_shaper.sources import folders, transcripts as C
from context_shaper.sources.ledger_store import LedgerStore, Merged
from context_shaper.sources.requests import prompt_measurements
from context_shaper.streaming import impact as live
from context_shaper.streaming.alerts import deep_check_stream, ledger_sink, owned_check_stream
from context_shaper.streaming.requests import (
    RESULT_SCHEMA,
    optimize_request_stream,
    request_result_stream,
    running_totals,
    running_totals_stream,
)
from context_shaper.streaming.savings import late_entries, savings_by_window, window_totals, windowed_savings_stream
from context_shaper.streaming.watch import watch_long_histories, watch_repeats
from tests import fixtures as X
from workload.queries import drain, state_store

EVENTS = "session_id string, ts bigint, bytes bigint, tokens bigint"


def local(path):
    return path.removeprefix("file:")


def run_again(checkpoint, batch):
    """Forget that a batch was committed, as when the driver is lost just before."""
    for name in (f"{batch}", f".{batch}.crc"):
        os.remove(f"{local(checkpoint)}/commits/{name}")


# --- ledger -------------------------------------------------------------------------------------


@given(st.lists(st.lists(st.integers(0, 30), max_size=8), max_size=5))
def test_merged_numbers(runs):
    held = Merged()
    for run in runs:
        held = held.plus(run)
    added = {number for run in runs for number in run}
    assert {n for n in range(35) if held.holds(n)} == added
    assert not held.beyond or held.beyond[0] > held.upto + 1


def checks(spark, first, last):
    return spark.range(first, last).select(
        F.col("id").alias("ts"), F.lit("s1").alias("sid"), (F.col("id") * 2).alias("tok"), F.lit(False).alias("warn")
    )


def test_append_during_compaction_loses_nothing(spark, monkeypatch):
    store = LedgerStore(spark, new_shared_path(spark, "ledger"))
    assert store.read().count() == 0 and store.compact(0) is None
    assert store.append(checks(spark, 0, 100), "a", 0) and not store.append(checks(spark, 0, 100), "a", 0)
    store.append(checks(spark, 100, 200), "a", 2)
    rival = LedgerStore(spark, store.root)
    write, seen = LedgerStore._write, []

    def interrupted(self, rows, path):
        write(self, rows, path)
        if not seen and "/bases/" in path:
            seen.append(path)
            rival.append(checks(spark, 1000, 1010), "a", 1)
            rival.append(checks(spark, 2000, 2005), "b", 0)
            assert rival.compact(max_bytes=0, keep=20) == 1

    monkeypatch.setattr(LedgerStore, "_write", interrupted)
    assert store.compact(max_bytes=0, keep=50) is None  # the rival was first
    assert Counter(store.read().select((F.floor("ts") / 1000).cast("int")).toPandas().iloc[:, 0]) == {1: 10, 2: 5, 0: 5}
    store.append(checks(spark, 3000, 3003), "b", 1)
    reader = store.snapshot()
    assert store.compact(max_bytes=0, keep=4) == 2
    assert sorted(r.ts for r in store.read().collect()) == [2004, 3000, 3001, 3002]
    assert store.read(reader).count() == 23  # an earlier reader still sees its generation
    store.vacuum()
    assert store.read().count() == 4
    assert not store.append(checks(spark, 0, 100), "a", 0)  # known, though its files are gone
    assert folders.subfolders(spark, f"{store.root}/parts/a") == []


def test_parts_that_were_not_finished_are_not_read(spark):
    store = LedgerStore(spark, new_shared_path(spark, "ledger"))
    store.append(checks(spark, 0, 5), "a", 0)
    os.remove(f"{local(store.root)}/parts/a/{0:012d}/_SUCCESS")
    assert store.read().count() == 0
    assert store.append(checks(spark, 0, 5), "a", 0) and store.read().count() == 5


def test_bad_lines_of_a_part_are_dropped(spark):
    store = LedgerStore(spark, new_shared_path(spark, "ledger"))
    lines = [("oops",), ('{"ts":1} x',), ('{"ts":5,"tok":7}',), ("",)]
    spark.createDataFrame(lines, "value string").write.text(f"{store.root}/parts/x/{0:012d}")
    assert [(r.ts, r.ev, r.tok) for r in store.read().collect()] == [(5, "check", 7)]


# --- streams --------------------------------------------------------------------------------------


def events(count, sessions=7):
    rng = random.Random(11)
    return [
        (f"s{rng.randrange(sessions)}", i, int(200_000 + i * 4000 * rng.random()), None if rng.random() < 0.1 else rng.randrange(50_000, 900_000))
        for i in range(count)
    ]


def test_ledger_sink_takes_each_batch_once(spark):
    rows, path = events(600), new_shared_path(spark, "sink")
    store, want = LedgerStore(spark, f"{path}/ledger"), A.deep_checks(spark.createDataFrame(rows, EVENTS))

    def go_on():
        stream = spark.readStream.schema(EVENTS).parquet(f"{path}/in")
        with state_store(spark):
            ledger_sink(deep_check_stream(stream), store, "alerts", f"{path}/checks", f"{path}/checkpoint").awaitTermination()

    for part in range(3):
        spark.createDataFrame(rows[200 * part : 200 * part + 200], EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        go_on()
        if part == 1:
            run_again(f"{path}/checkpoint", part)
            go_on()
            store.compact(max_bytes=0, keep=10**6)
            run_again(f"{path}/checkpoint", part)
            go_on()
    got = sorted((r.ts, r.sid, r.tok, r.warn) for r in store.read().collect())
    assert got == sorted((r.ts, r.session_id, r.tokens, r.warn) for r in want.collect())
    assert spark.read.parquet(f"{path}/checks").count() == len(got)


def test_running_totals_go_on_after_a_restart(spark):
    schema = "request_id string, method string, path string, body string"
    rows = [(f"r{i}", "POST", "/v1/messages" if i % 3 else "/v1/nope", X.REQUEST if i % 2 else X.OPENAI) for i in range(12)]
    path = new_shared_path(spark, "running")

    def go_on():
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        optimize_request_stream(stream, f"{path}/results", f"{path}/first").awaitTermination()
        results = request_result_stream(spark, f"{path}/results")
        running_totals_stream(results, f"{path}/totals", f"{path}/second").awaitTermination()

    for part in range(2):
        spark.createDataFrame(rows[6 * part : 6 * part + 6], schema).write.mode("append").parquet(f"{path}/in")
        go_on()
    run_again(f"{path}/first", 1)
    run_again(f"{path}/second", 1)
    go_on()  # both run their last batch again; results stay, totals are the same
    for part in range(2):
        sofar = spark.createDataFrame(rows[: 6 * part + 6], schema)
        want = Q.request_totals(Q.request_results(sofar, Q.optimize_requests(sofar)))
        got = running_totals(spark, f"{path}/totals").filter(F.col("batch_id") == part).drop("batch_id")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert spark.read.schema(RESULT_SCHEMA).parquet(f"{path}/results").count() == 8


def plain_owned(rows, saved, keep, warn=80_000, factor=1.4):
    """Owner by owner, event by event, over a dictionary of sessions."""
    memory, found = {}, []

    def forget(sessions):
        while len(sessions) > keep:
            del sessions[min(sessions, key=lambda name: (sessions[name][2], name))]

    for owner, session, t, b, touched in saved:
        memory.setdefault(owner, {})[session] = (t, b, touched)
        forget(memory[owner])
    for owner, session, ts, size, tokens in sorted(rows, key=lambda r: (r[0], r[2], r[1], r[3], r[4] or 0)):
        sessions = memory.setdefault(owner, {})
        t, b, _ = sessions.get(session, (0, 0, 0))
        if size < 4 * warn or tokens is None or (b > 0 and size < b * factor):
            continue
        shout = tokens >= warn and tokens >= t * factor
        sessions[session] = (tokens if shout else t, size, ts)
        forget(sessions)
        found.append((owner, session, ts, size, tokens, True, shout))
    return sorted(found)


def test_state_of_an_owner_is_bounded(spark):
    schema = f"owner string, {EVENTS}"
    rows = [(f"m{int(sid[1:]) % 3}", sid, *rest) for sid, *rest in events(900, 30)]
    old = [(f"m{i % 3}", f"s{i}", "70000" if i % 2 else '{"t":0,"b":500000}' if i % 4 else '{"t":1,"b":300000,"touched":-1}', -i) for i in range(0, 30, 3)]
    frame = spark.createDataFrame(rows, schema)
    state = A.migrate_owned_state(spark.createDataFrame(old, "owner string, session_id string, entry string, saved bigint"), "saved")
    saved = [tuple(r) for r in state.collect()]
    assert {r[1]: r[4] for r in saved}["s12"] == -1 and {r[1]: r[2:4] for r in saved}["s3"] == (70_000, 0)
    for keep in (3, 100):
        want = plain_owned(rows, saved, keep)
        assert sorted(map(tuple, A.owned_checks(frame, keep=keep, initial_state=state).collect())) == want
    path = new_shared_path(spark, "owned")
    for part in range(3):
        spark.createDataFrame(rows[300 * part : 300 * part + 300], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(owned_check_stream(stream, keep=3, initial_state=state), "owned").collect()
    assert sorted(map(tuple, got)) == plain_owned(rows, saved, 3) != plain_owned(rows, saved, 100)
    unlimited = A.deep_checks(frame).select("session_id", "ts", "bytes", "tokens", "deep_check", "warn")
    assert sorted(map(tuple, unlimited.collect())) == sorted(r[1:] for r in plain_owned(rows, [], 10**6))


# --- transcripts ----------------------------------------------------------------------------------


def talk(path, count, word="words", model="gpt-4o"):
    path.parent.mkdir(exist_ok=True)
    lines = [{"type": "user", "message": {"role": "user", "content": f"{word} " * 40}}] * count
    lines += [{"type": "assistant", "message": {"role": "assistant", "content": "ok", "model": model}}]
    path.write_text("\n".join(map(json.dumps, lines)))


def files_opened(frame):
    """Files read by the scans of a frame's plan, from their metrics."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        total += metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0
    return total


def test_small_files_are_not_opened(spark, tmp_path):
    for i in range(6):
        talk(tmp_path / "p" / f"session-{i}.jsonl", 2 if i < 4 else 60)
    assert files_opened(C.transcript_entries(spark, str(tmp_path)).select("path", "type")) == 6
    gated = C.transcript_entries(spark, str(tmp_path), min_bytes=10_000).select("path", "type")
    assert files_opened(gated) == 2 and gated.select("path").distinct().count() == 2


def test_gated_checks_equal_reading_everything(spark, tmp_path):
    sizes = [1, 5, 10, 20, 40, 80, 30, 30]
    for i, size in enumerate(sizes):
        talk(tmp_path / "p" / f"session-{i}.jsonl", size)
    talk(tmp_path / "p" / "odd +%20name.jsonl", 90)
    (tmp_path / "p" / "empty-but-large.jsonl").write_text("{}\n" * 3000)
    options = A.AlertOptions(warn_tokens=800)
    files = C.session_inventory(spark, str(tmp_path), limit=None)
    name = F.regexp_extract("path", r"([^/]+)\.jsonl", 1)
    prompts = files.select(F.lit(1).alias("ts"), name.alias("session_id"), F.col("path").alias("transcript_path"))
    prompts = prompts.unionByName(prompts.withColumn("ts", F.lit(2))).unionByName(
        spark.createDataFrame([(3, "x", None), (3, "y", ""), (3, "z", "file:/nowhere.jsonl")], "ts int, session_id string, transcript_path string")
    )
    stat = {r.path.split("/")[-1][:-6]: (r.path, r.size_bytes) for r in files.collect()}
    state = spark.createDataFrame(
        [("session-6", 10**9, stat["session-6"][1] // 2), ("session-7", 0, stat["session-7"][1] - 9), ("other", 1, 2)],
        "session_id string, t bigint, b bigint",
    )
    found = check_sessions(spark, str(tmp_path), prompts, state, options)
    assert {path.split("/")[-1][:-6] for path in found.paths} == {
        "session-3", "session-4", "session-5", "session-6", "empty-but-large", "odd +%20name"
    }

    messages = C.transcript_messages(C.transcript_entries(spark, str(tmp_path)))
    totals = conversation_totals(measure(messages, ("tokens",))).select(F.col("conv_id").alias("path"), "total_tokens")
    measured = prompt_measurements(prompts, files.join(totals, "path", "left"))
    full = A.owned_checks(
        measured.withColumn("owner", F.lit("o")), options, 100,
        state.select(F.lit("o").alias("owner"), "session_id", "t", "b", F.lit(0).cast("bigint").alias("touched")),
    ).drop("owner")
    assert sorted(map(tuple, found.checks.collect())) == sorted(map(tuple, full.collect()))
    after = {r.session_id: (r.t, r.b) for r in found.state.collect()}
    assert after["other"] == (1, 2) and after["session-6"] == (10**9, stat["session-6"][1])
    assert after["session-5"][0] > 800 and "session-0" not in after and "empty-but-large" not in after
    again = check_sessions(spark, str(tmp_path), prompts, found.state, options)
    assert {p.split("/")[-1] for p in again.paths} == {"empty-but-large.jsonl"} and again.checks.count() == 0


def test_refresh_reads_only_what_changed(spark, tmp_path):
    table, root = ProfileTable(spark, new_shared_path(spark, "profiles")), tmp_path / "files"
    root.mkdir()
    assert table.refresh(str(root / "none*")).profiles.count() == 0
    for i in range(4):
        talk(root / f"p{i % 2}" / f"session-00{i}.jsonl", 3 + i, model="gpt-4o" if i < 3 else "nobody")
    (root / "p0" / "nothing-said.jsonl").write_text('{"type":"mode"}\n')
    first = table.refresh(str(root))
    assert len(first.read) == 5
    before = {r.path.split("/")[-1]: r for r in first.profiles.collect()}
    talk(root / "p0" / "session-000.jsonl", 9)
    talk(root / "p1" / "session-new.jsonl", 1)
    (root / "p1" / "session-001.jsonl").unlink()
    second = table.refresh(str(root))
    assert sorted(p.split("/")[-1] for p in second.read) == ["session-000.jsonl", "session-new.jsonl"]
    rows = {r.path.split("/")[-1]: r for r in second.profiles.collect()}
    assert set(rows) == {"session-000.jsonl", "session-002.jsonl", "session-003.jsonl", "session-new.jsonl", "nothing-said.jsonl"}
    assert rows["session-000.jsonl"].message_count == 10 and rows["session-002.jsonl"] == before["session-002.jsonl"]
    assert rows["nothing-said.jsonl"].message_count == 0
    third = table.refresh(str(root))
    assert third.read == [] and third.profiles.count() == 5

    activity = spark.createDataFrame([("session-002.", 7, 2)], "sid string, reduction bigint, warn_count bigint")
    report = report_from_files(table, str(root), activity)
    assert {r.sid: (r.reduction, r.warn_count) for r in report.collect() if r.reduction} == {"session-002.": (7, 2)}
    by_name = report.select("project", "model", "total_tokens", "waste_usd").collect()
    assert len(by_name) == 4  # a session without messages is not in it
    rolled = I.fleet_rollup(report, ["project", "model"]).collect()
    level = Counter(r.level for r in rolled)
    assert level == {0: 3, 1: 2, 2: 1}
    assert next(r.total_tokens for r in rolled if r.level == 2) == sum(r.total_tokens for r in by_name)
    assert {r.grouping for r in I.fleet_cube(report, ["project", "model"]).collect()} == {0, 1, 2, 3}
    table.compact(C.session_inventory(spark, str(root), limit=None))
    assert table.refresh(str(root)).read == [] and table.stored().count() == 5


# --- a hot conversation ------------------------------------------------------------------------------


def test_history_of_a_hot_conversation(spark):
    """A million messages of one conversation in three triggers, most of them tool results; then the turns come."""
    schema, path, count = "conv_id string, pos bigint, tokens bigint, kind string", new_shared_path(spark, "hot"), 1_000_000
    rows = spark.range(count).select(
        F.lit("hot").alias("conv_id"), F.col("id").alias("pos"), (F.col("id") * 7919 % 1000).alias("tokens"),
        F.when(F.col("id") % 25_000 == 0, "user").otherwise("tool_result").alias("kind"),
    )
    extra = spark.createDataFrame([("hot", count + i, 5, "user") for i in range(3)], schema)
    cold = spark.range(50).select(F.lit("cold").alias("conv_id"), F.col("id").alias("pos"), F.lit(2).cast("bigint").alias("tokens"), F.lit("user").alias("kind"))
    parts = [rows.filter("pos >= 700000"), rows.filter("pos < 400000"), rows.filter("pos BETWEEN 400000 AND 699999"), extra.unionByName(cold)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = {r.conv_id: r for r in drain(watch_long_histories(stream), "history").collect()}
    half = sum(i * 7919 % 1000 for i in range((count + 3) // 2))
    assert found["hot"].message == f"Conversation has 43 turns; the older half holds ~{half} tokens."
    assert found["cold"].est_savings == 35 and len(found) == 2


def test_chunks_of_any_size_give_the_same_report(spark):
    rng, schema = random.Random(2), "conv_id string, pos bigint, tokens bigint, kind string"
    rows = [(c, i, rng.randrange(500), rng.choice(["user", "assistant", "tool_result"])) for c in "abc" for i in range(90)]
    rng.shuffle(rows)
    reports = set()
    for size in (1, 7, 4096):
        path = new_shared_path(spark, "chunks")
        for i in range(3):
            spark.createDataFrame(rows[90 * i : 90 * i + 90], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        reports.add(tuple(sorted((r.conv_id, r.message) for r in drain(watch_long_histories(stream, chunk_rows=size), "history").collect())))
    assert len(reports) == 1 and len(next(iter(reports))) == 3


def test_copies_that_arrive_out_of_order(spark):
    """The first copy is the least of the first trigger that has one; nothing is reported twice."""
    schema, path = "conv_id string, content_key string, msg_index bigint, tokens bigint", new_shared_path(spark, "late")
    for part in ([("c", "k", 5, 10), ("c", "k", 3, 10)], [("c", "k", 1, 10), ("c", "k", 9, 10)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert sorted(tuple(r.messages) for r in drain(watch_repeats(stream), "repeats").collect()) == [(3, 1), (3, 5), (3, 9)]


# --- continuous impact, pattern tables ---------------------------------------------------------------


def test_continuous_impact_equals_batch_after_every_trigger(spark):
    rng, path = random.Random(6), new_shared_path(spark, "impact")
    schema = "ts bigint, ev string, sid string, tok bigint, warn boolean, src string, saved bigint, model string, seq bigint"
    rows = [
        (rng.randrange(40_000), rng.choice(["check", "check", None, "optimize"]), rng.choice(["a", "b", "c", "", None]),
         rng.choice([None, rng.randrange(1000)]), rng.choice([True, False, None]), "cli", rng.choice([None, 50, 70]),
         rng.choice(["gpt-4o", "claude-opus-4-1", "else", None]), i)
        for i in range(400)
    ]
    for part in range(4):
        spark.createDataFrame(rows[100 * part : 100 * part + 100], schema).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/ledger")
        with state_store(spark):
            for run in live.impact_streams(stream, path, bucket_ms=1000):
                run.awaitTermination()
        if part == 2:
            run_again(f"{path}/checkpoints/activity", part)
    for part in range(4):
        sofar = spark.createDataFrame(rows[: 100 * part + 100], schema)
        for got, want in (
            (live.activity_as_of(spark, path, part), I.session_activity(sofar)),
            (live.savings_as_of(spark, path, part), I.savings_by_family(sofar)),
            (live.hook_activity_as_of(spark, path, part), I.hook_activity(sofar)),
        ):
            rounded = [sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()), key=repr) for f in (got, want)]
            assert rounded[0] == rounded[1]


def test_tables_of_patterns_equal_the_chain(spark):
    rng = random.Random(1)
    parts = ["claude", "opus", "sonnet", "-5", "haiku", "gpt-4", "o", "-mini", "GPT-5", "o3", "gemini", "-2.0-flash", "llama", "3", " ", "mythos", "mixtral"]
    names = [("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))),) for _ in range(400)] + [(None,), ("",)]
    rows = spark.createDataFrame(names, "model string")
    found = K.with_pattern_values(K.with_pattern_values(rows, "model", K.window_table(spark)), "model", K.price_table(spark))
    price = M.pricing(F.col("model"))
    want = rows.select("model", M.context_window(F.col("model")), *[price[x] for x in ("input_per_m", "output_per_m", "cache_read_per_m")])
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    ties = spark.createDataFrame([(2, "a", "late"), (1, "b$", "second"), (1, "a", "first")], "priority int, pattern string, kind string")
    got = {r.model: r.kind for r in K.with_pattern_values(spark.createDataFrame([("AB",), ("xb",), ("c",)], "model string"), "model", ties).collect()}
    assert got == {"AB": "first", "xb": "second", "c": None}


def test_windows_and_late_lines_equal_batch(spark):
    rng, path, delay, width = random.Random(8), new_shared_path(spark, "windows"), 150, 100
    schema = "ts bigint, ev string, model string, saved bigint"
    parts = [
        [(part * 400 + rng.randrange(-700, 400) % (part * 400 + 400), "optimize", rng.choice(["gpt-4o", "x", None]), rng.choice([None, 10, 20])) for _ in range(60)]
        for part in range(4)
    ]
    parts[1].append((10**6, "check", None, None))  # other events do not move the watermark

    def go_on():
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        windowed_savings_stream(stream, f"{path}/out", delay, width).awaitTermination()

    greatest, ontime, late = None, [], []
    for number, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        go_on()
        if number == 2:
            run_again(f"{path}/out/checkpoint", number)
            go_on()
        mark = 0 if greatest is None else max(greatest - delay, 0)
        runs = [row for row in part if row[1] == "optimize"]
        for row in runs:
            (late if row[0] // width * width + width <= mark else ontime).append(row)
        greatest = max([greatest or 0, *(row[0] for row in runs)])
        got = window_totals(spark, f"{path}/out", delay, number, width)
        want = savings_by_window(spark.createDataFrame(ontime, schema), width)
        assert sorted(map(repr, map(tuple, got.drop("final").collect()))) == sorted(map(repr, map(tuple, want.collect())))
        assert {r.start for r in got.collect() if r.final} == {row[0] // width * width for row in ontime if row[0] // width * width + width <= max(greatest - delay, 0)}
    assert late and sorted(map(repr, map(tuple, late_entries(spark, f"{path}/out", 3).select("ts", "ev", "model", "saved").collect()))) == sorted(map(repr, late))
