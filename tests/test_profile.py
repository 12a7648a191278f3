import json
import random
from collections import Counter

from pyspark.sql import functions as F

from context_shaper.operators import findings as N, totals as S
from context_shaper.operators.measure import measure
from context_shaper.operators.normalize import conversations, from_turns, normalize
from context_shaper.operators.ordering import dense_positions
from context_shaper.plans.profile import headline, profile
from context_shaper.sources.documents import open_documents, rejected_documents
from tests import fixtures as X, plain


def test_formats_and_kinds(spark):
    rows = normalize(X.raw(spark, a=X.OPENAI, b=X.ANTHROPIC, c="just some prompt text")).orderBy("conv_id", "pos").collect()
    kinds = [(r.conv_id, r.msg_index, r.kind, r.tool_name) for r in rows]
    assert kinds == [
        ("a", 0, "system", None), ("a", 1, "user", None), ("a", 2, "tool_call", "list_tickets"), ("a", 3, "tool_result", None), ("a", 4, "assistant", None),
        ("b", -1, "system", None), ("b", 0, "user", None), ("b", 1, "tool_call", "list_tickets"), ("b", 2, "tool_result", None), ("b", 3, "assistant", None),
        ("c", 0, "user", None)]
    formats = {r.conv_id: r.source_format for r in conversations(X.raw(spark, a=X.OPENAI, b=X.ANTHROPIC, c="x", d="[]")).collect()}
    assert formats == {"a": "openai", "b": "anthropic", "c": "text", "d": "array"}


def test_block_reading(spark):
    block = {"type": "tool_result", "content": [{"type": "text", "text": "in"}, {"type": "document"}, {"type": "tool_result", "content": [{"type": "text", "text": "deep"}]}]}
    deeper = {"type": "tool_result", "content": "z"}
    for _ in range(6):
        deeper = {"type": "tool_result", "content": [deeper]}
    contents = {
        "str": "[1]", "list": [1], "empty": [], "none": None, "obj": {"b": 1, "a": "😀"}, "mixed": ["plain", None, 5, '{"type":"text","text":"no"}', {"type": "text", "text": "yes"}],
        "nest": [block], "deep": [deeper], "hollow": [{"type": "tool_result", "content": [{"type": "tool_result", "content": []}]}], "call": [{"type": "tool_use", "name": "f", "input": {"z": 1, "a": "\\uD83D\\uDE00 😀"}}, {"type": "tool_result", "content": "r"}],
        "last": [{"type": "tool_result", "content": "r"}, {"type": "tool_use", "name": "g"}], "other": [{"type": "odd", "v": "😀"}],
    }
    raw = X.raw(spark, **{k: json.dumps([{"role": "user", "content": v}], ensure_ascii=False) for k, v in contents.items()})
    got = {r.conv_id: r for r in normalize(raw).collect()}
    texts = {k: r.text for k, r in got.items()}
    assert texts == {
        "str": "[1]", "list": "1", "empty": "", "none": '""', "obj": '{"b":1,"a":"😀"}', "mixed": 'plain5{"type":"text","text":"no"}yes',
        "nest": "in[document]deep", "deep": "z", "hollow": "", "call": '[tool call: f] {"z":1,"a":"\\\\uD83D\\\\uDE00 😀"}r', "last": "r[tool call: g] {}", "other": '{"type":"odd","v":"😀"}'}
    assert {k: r.opt_text for k, r in got.items()} == {k: plain.reading(v) for k, v in contents.items()}
    assert (got["nest"].has_binary, got["call"].kind, got["last"].kind, got["last"].tool_name) == (True, "tool_result", "tool_call", "g")
    assert got["deep"].is_tool_result and got["last"].is_tool_result


def test_unreadable_bodies(spark):
    bodies = {"n": "null", "m": '{"messages":"x"}', "e": '[null]', "t": "[1] x", "b": '{"messages":[]}}', "k": '{"a":1,"a":2}', "u": '﻿{"messages":[]}', "x": "[NaN]", "s": '"hi"'}
    rows = {r.conv_id: (r.doc_format, r.parse_error) for r in open_documents(X.raw(spark, **bodies)).collect()}
    assert rows == {"n": ("object", "null document"), "m": ("object", "messages is not a list"), "e": ("array", "null message"), "t": ("text", None),
                    "b": ("text", None), "k": ("object", None), "u": ("text", None), "x": ("text", None), "s": ("object", None)}
    assert rejected_documents(X.raw(spark, **bodies)).count() == 3


def test_known_profile(spark):
    raw = X.raw(spark, a=X.OPENAI, e='{"messages":[]}').withColumn("model", F.lit("gpt-4o"))
    profiles, found = profile(normalize(raw), conversations=conversations(raw))
    rows = {r.conv_id: r for r in profiles.collect()}
    a = rows["a"]
    assert (a.total_tokens, a.context_window, a.total_est_savings, a.finding_count, rows["e"].total_tokens, rows["e"].finding_count) == (2651, 128_000, 2083, 2, 0, 1)
    assert abs(a.cost.per_call_usd - 0.0066275) < 1e-12 and [m.msg_index for m in a.largest_messages] == [3, 2, 1, 4, 0]
    assert [r.finding for r in N.ordered_findings(found.filter("conv_id = 'a'")).collect()] == ["large_tool_result", "cache_ordering"]
    assert headline(profiles).filter("conv_id = 'a'").first().cost_line.startswith("~$0.0066 input per call · ~$6.63 per 1k calls")


def turns(spark, n=300):
    text = "We discussed the deployment pipeline and database migrations at length. " * 80
    rows = [("h", i, "assistant" if i % 2 else "user", text) for i in range(n)]
    return spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")


def test_overlapping_savings_add_up(spark):
    profiles, _ = profile(from_turns(turns(spark), "conv_id", "turn"))
    row = profiles.first()
    assert (row.total_tokens, row.total_est_savings) == (433_200, 582_180)


def test_hot_conversation_in_small_chunks(spark):
    """One conversation whose messages mostly repeat, cut into chunks of seven."""
    rng = random.Random(5)
    pool = ["copy " * 80, "second " * 60, *[f"{i} " * 200 for i in range(20)]]
    texts = [rng.choice(pool[:2]) if rng.random() < 0.7 else rng.choice(pool) for _ in range(400)]
    rows = [("hot", i, rng.choice(["user", "assistant", "tool"]), t) for i, t in enumerate(texts)]
    measured = measure(from_turns(spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string"), "conv_id", "turn"))
    limits = N.Thresholds(chunk_rows=7, long_history_turns=10)
    first, want = {}, []
    for i, t in enumerate(texts):
        if i != first.setdefault(t, i):
            want.append((i, first[t], plain.tokens(t)))
    got = N.duplicate_content(measured, limits).select(F.col("messages")[1], F.col("messages")[0], "est_savings").collect()
    assert sorted(map(tuple, got)) == want
    history = N.long_histories(measured, S.conversation_totals(measured), limits).first()
    older = sum(plain.tokens(t) + 4 for t in texts[:200])
    assert f"~{older} tokens" in history.message
    top = S.largest_messages(measured).orderBy("rank").collect()
    assert [r.msg_index for r in top] == sorted(range(400), key=lambda i: (-plain.tokens(texts[i]), i))[:5]


def test_repeated_calls_come_in_bounded_parts(spark):
    calls = [{"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "f", "arguments": str(i % 3)}}]} for i in range(30)]
    measured = measure(normalize(X.raw(spark, a=json.dumps({"messages": calls}))))
    whole = N.repeated_tool_calls(measured).collect()
    assert [len(r.messages) for r in whole] == [10, 10, 10] and {r.part for r in whole} == {0}
    parts = N.repeated_tool_calls(measured, N.Thresholds(chunk_rows=8)).collect()
    assert Counter(i for r in parts for i in r.messages) == Counter(range(30)) and max(len(r.messages) for r in parts) <= 8
    assert sum(r.part == 0 for r in parts) == 3 and all("appears 10 times" in r.message for r in parts)
    for limits in (N.Thresholds(), N.Thresholds(chunk_rows=8)):
        ranked = N.ranked_findings(N.repeated_tool_calls(measured, limits)).collect()
        assert sorted({(r.rank, min(r.messages)) for r in ranked if r.part == 0}) == [(1, 0), (2, 1), (3, 2)]
        assert all({i % 3 for i in r.messages} == {r["rank"] - 1} for r in ranked)


def test_thresholds_are_strict(spark):
    def conv(n_tokens, role="tool"):
        return json.dumps([{"role": role, "content": "w" * (4 * (n_tokens - 4))}])
    measured = measure(normalize(X.raw(spark, a=conv(2000), b=conv(2001), c=conv(8000), d=conv(8001))))
    got = {r.conv_id: r.severity for r in N.large_tool_results(measured).collect()}
    assert got == {"b": "warn", "c": "warn", "d": "high"}
    totals = spark.createDataFrame([("a", 70.0), ("b", 70.1), ("c", 90.0), ("d", 90.1)], "conv_id string, usage_pct double").withColumn("model", F.lit("m"))
    assert {r.conv_id: r.severity for r in N.window_pressure(totals).collect()} == {"b": "warn", "c": "warn", "d": "high"}
    system = spark.createDataFrame([("a", 8000, 2000), ("b", 8004, 2001), ("c", 8000, 2001)], "conv_id string, total_tokens bigint, system_tokens bigint")
    assert [r.conv_id for r in N.large_system_prompts(system).collect()] == ["c"]


def test_dense_positions(spark):
    rng = random.Random(1)
    rows = [(k, v) for k in "ab" for v in rng.sample(range(1000), 120)]
    got = dense_positions(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v", "pos", chunk_rows=10).collect()
    for key in "ab":
        values = sorted(v for k, v in rows if k == key)
        assert sorted((r.pos, r.v) for r in got if r.k == key) == list(enumerate(values))


def test_top_rows_are_limited_before_the_shuffle(spark):
    plan = S.largest_messages(measure(from_turns(turns(spark, 20), "conv_id", "turn")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
