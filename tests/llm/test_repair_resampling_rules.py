"""Conversation repair, target resampling and fertility rules against brute force, and on untidy tables."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from context_shaper.llm.bit_planes import BitSlices, bucket_gains, gain_planes, importance_weights, plane_sums, resample_to_target
from context_shaper.llm.conversation_repair import Repair, audit_conversations, repaired_messages
from context_shaper.llm.fertility import Fertility, fertility_bands, judge_fertility, measure_fertility
from context_shaper.llm.four_russians import EditCosts, block_tables, final_vector
from context_shaper.llm.queries import damaged

MESSAGES = "conv_id bigint, turn bigint, role string, text string"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 4000


# --- conversation repair: a shortest path over (row, state), the least word among the cheapest ------


def cheapest(rows):
    """(cost, audit) of rows (initial, status) by a search over single edits."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        made = "a" if state == "u" else "u"
        heapq.heappush(queue, (cost + 5, audit + "I", at, made))
        if at < len(rows):
            initial, status = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, state))
            if status in ("fine", "truncated"):
                extra = 5 if status == "truncated" else 0
                heapq.heappush(queue, (cost + 1 + extra, audit + "R", at + 1, made))
                if initial in after[state]:
                    heapq.heappush(queue, (cost + extra, audit + "K", at + 1, after[state][initial]))


def plain_audit(rows):
    """What audit_conversations says of one conversation's (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
    seen, marked = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        status = (
            "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "fine"
        )
        seen.add((role, text))
        marked.append((role[:1], status))
    cost, audit = cheapest(marked)
    out, at, state = [], 0, ""
    for letter in audit:
        role, text = rows[at][1:] if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "K":
            state = role[:1]
        elif letter in "RI":
            state = "a" if state == "u" else "u"
            role = {"u": "user", "a": "assistant"}[state]
        if letter != "D":
            out.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    statuses = Counter(status for _, status in marked)
    pairs = zip([i for i, _ in marked], [i for i, _ in marked[1:]])
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, statuses["blank"], statuses["duplicate"],
        statuses["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


AUDIT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_conversations(seed, count, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "unit"]
    texts = ["Yes.", "No!", "cut off", " \n", "", None, "Why?", "Fine. ", "é…", "ok.\n"]
    return {
        conv: [
            (rng.choice([None, *range(12)]), rng.choices(roles, [8, 8, 3, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(99)}.")
            for _ in range(rng.randrange(1, most))
        ]
        for conv in range(count)
    }


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_audits_equal_a_search_over_single_edits(spark, chunk):
    talks = random_conversations(11, 150, 14)
    rows = spark.createDataFrame([(c, *row) for c, rows in talks.items() for row in rows], MESSAGES).repartition(5)
    got = {r.conv_id: tuple(r[x] for x in AUDIT) for r in audit_conversations(rows, Repair(chunk=chunk)).collect()}
    assert got == {c: plain_audit(rows) for c, rows in talks.items()}


def test_one_long_conversation_is_cut_and_put_together(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["user", "assistant", "system"]), f"t{rng.randrange(400)}" + rng.choice([".", "."])) for i in range(3000)]
    rows += [(7, "user", "again.")] * 2000  # one row many times
    frame = spark.createDataFrame([(1, *row) for row in rows], MESSAGES).repartition(4)
    got = audit_conversations(frame, Repair(chunk=64)).collect()
    assert [tuple(r[x] for x in AUDIT) for r in got] == [plain_audit(rows)]


def test_repaired_messages_are_legal_and_in_order(spark):
    talks = random_conversations(3, 60, 10)
    rows = spark.createDataFrame([(c, *row) for c, rows in talks.items() for row in rows], MESSAGES)
    out = {}
    for r in sorted(repaired_messages(rows).collect(), key=lambda r: (r.conv_id, r.position)):
        out.setdefault(r.conv_id, []).append(r)
    for conv, found in out.items():
        assert [r.position for r in found] == list(range(len(found)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in found))
        lines = "\n".join(f"{r.role}:{r.text}" for r in found)
        assert hashlib.sha256(lines.encode()).hexdigest() == plain_audit(talks[conv])[-1]
        assert all((r.turn is None and r.text == "") for r in found if r.edit == "I")


def test_repair_of_untidy_tables(spark):
    schema = MESSAGES + ", chunk string, edits int, key string, letters string, c int"
    extra = ("x", None, None, "y", 1)
    rows = [(None, None, None, None), (None, 1, "user", LONG), (2, None, "user", "a."), (2, None, "user", "a."), (3, 0, "", "")]
    frame = spark.createDataFrame([(*row, *extra) for row in rows], schema)
    got = {r.conv_id: tuple(r[x] for x in AUDIT) for r in audit_conversations(frame).collect()}
    assert got == {c: plain_audit([row[1:] for row in rows if row[0] == c]) for c in (None, 2, 3)}
    assert audit_conversations(frame.limit(0)).count() == 0 and repaired_messages(frame.limit(0)).count() == 0
    # Ties are decided by role and a hash of the text, whatever the order of rows.
    assert {r.conv_id: r.audit for r in audit_conversations(frame.orderBy(F.desc("text"))).collect()} == {c: got[c][6] for c in got}


def test_damage_is_decided_by_conversation_and_turn(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in [None, *range(8)]]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in damaged(spark.createDataFrame(rows, MESSAGES)).collect())
    want = Counter()
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else "One Two" if fault == 2 else text
        want[conv, turn, "user" if fault == 4 else role, text] += 0 if fault == 0 else 2 if fault == 3 else 1
    assert got == +want


def test_other_costs(spark):
    costs = EditCosts(rerole=3, delete=4, insert=1, truncated=2)
    tables = block_tables(costs)
    edits, state = tables.trace(tables.blocks("BB"), final_vector(costs))[0]
    assert (edits, state) == ("KIK", 2)  # user, inserted assistant, user; the tail adds the last answer


# --- target resampling --------------------------------------------------------------------------


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(run.encode()) % 10_000 for run in runs]


def plain_resample(docs, target):
    raw = Counter(b for _, text in docs for b in plain_features(text)[1])
    wanted = Counter(b for text in target for b in plain_features(text)[1])
    s, t = sum(raw.values()) + 10_000, sum(wanted.values()) + 10_000
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * t**-1 * s / (raw[b] + 1))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        words, buckets = plain_features(text)
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words), len(buckets), weight, score, None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, row in enumerate(able[: len(able) * 5 // 100], 1):
        row[5] = rank
    return sorted(((r[0], *r[2:]) for r in rows), key=repr)


def test_resampling_equals_its_definition(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ÉTÉ", "x" * 300, "it's", "a-b", "日本"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "!!! --"), (903, LONG), (None, LONG), (5, docs[5][1]), (904, "y" * 70_000 + " Z z")]
    target = ["w1 w2 w3 Ünder", None, "", LONG[:500]]
    frame = spark.createDataFrame([(i, t, 7, "r") for i, t in docs], "doc_id bigint, text string, weight int, rank string").repartition(3)
    items = spark.createDataFrame([(t, "b") for t in target], "text string, bucket string")
    got = resample_to_target(frame, items).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_resample(docs, target)


def test_equal_scores_go_to_the_smaller_doc_id(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = spark.createDataFrame([(i % 40, text) for i in range(80)], "doc_id bigint, text string")
    drawn = resample_to_target(rows, rows.limit(0).select("text"), BitSlices(percent=50)).collect()
    ranked = sorted((r for r in drawn if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 41))
    assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in ranked)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resample_to_target(none, none).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    assert [r.weight for r in importance_weights(one, none).collect()] == [plain_resample([(1, "some words")], [])[0][2]]


def test_planes_sum_exactly():
    rng = random.Random(9)
    gains = [rng.randrange(-30_000, 30_000) for _ in range(10_000)]
    import numpy as np

    counts = np.array([[rng.choice([0, 0, 0, 1, 2, 1000, 2**31]) for _ in range(10_000)] for _ in range(3)])
    assert plane_sums(counts.copy(), gain_planes(gains)).tolist() == (counts @ np.array(gains)).tolist()
    assert bucket_gains(np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)) == [0] * 10_000


# --- fertility rules ------------------------------------------------------------------------------


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_figures_equal_their_definition(spark):
    rng = random.Random(4)
    words = ["a", "A", "b", "ünd", "#x", "<b>", "日本語", "a b", "\x1f", "c|d", "“q”"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.randrange(0, 90))) for _ in range(200)]
    texts += [None, "", " \n\n ", "a a a a", "x\nx\n x\nx", LONG, LONG, "z" * 60_000, "\n".join(["same line here"] * 50)]
    frame = spark.createDataFrame([(i, t, "xx", i) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, n_words int")
    got = {r.doc_id: tuple(r[x] for x in BASE) for r in judge_fertility(frame).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}


def plain_measures(text, options):
    """By encoding word after word."""
    from context_shaper.llm.fertility import _load

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = []
    for name in options.vocabularies:
        encode, partial = _load(f"{options.folder}/{name}")
        ids = [i for word in words for i in encode([word])[0]]
        shares = [n / len(ids) for n in Counter(ids).values()]
        out += [sum(map(len, words)) / len(ids), sum(bool(partial[i]) for i in ids) / len(ids), -sum(p * math.log2(p) for p in shares)]
    return out


def test_measures_and_verdicts_equal_brute_force(spark):
    rng, options = random.Random(8), Fertility(min_group=20)
    syllables = ["the", "tion", "er", "ing", "land", "be", "ma", "so"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(70, 120))), rng.choice(["en", "en", None])) for i in range(120)]
    odd = ["".join(chr(rng.randrange(0x1F300, 0x1F600)) for _ in range(3)) + " " + word() for _ in range(80)]
    docs += [(200, " ".join(odd), "en"), (201, " ".join(f"{rng.randrange(10**9):x}" for _ in range(80)), "en"), (202, "день " * 3, "ru")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(3)
    measured = {r.doc_id: r for r in measure_fertility(frame, options).collect()}
    for doc_id, text, _ in docs:
        assert [measured[doc_id][m] for m in options.measures] == pytest.approx(plain_measures(text, options))
    assert measured[202].script == "Cyrillic" and measured[0].script == "Latin"

    groups = {}
    for doc_id, text, lang in docs:
        row, base = measured[doc_id], plain_base(text)
        if not base[5]:
            length = int(math.log2(base[0]))
            for key in ((row.script, lang or "", length), (row.script, lang or ""), (row.script,)):
                groups.setdefault(key, set()).add(tuple(row[m] for m in options.measures))
    kept = {}
    for doc_id, text, lang in docs:
        row, base = measured[doc_id], plain_base(text)
        keys = [(row.script, lang or "", int(math.log2(max(base[0], 1)))), (row.script, lang or ""), (row.script,)]
        rows = next((groups[k] for k in keys if len(groups.get(k, ())) >= options.min_group), None)
        kept[doc_id] = not base[5]
        for place, name in enumerate(options.measures if rows and not base[5] else []):
            values = sorted(r[place] for r in rows)
            low, middle, high = (values[max(math.ceil(q * len(values)) - 1, 0)] for q in (0.25, 0.5, 0.75))
            floor = options.floors[place % 3] * (1 if place % 3 == 1 else abs(middle))
            unit = max((high - low) / 1.349, floor)
            kept[doc_id] &= middle - options.width * unit <= row[name] <= middle + options.width * unit
    got = {r.doc_id: r.kept for r in judge_fertility(frame, options).collect()}
    assert got == kept and not got[200] and not got[201] and sum(got.values()) > 110


def test_copies_do_not_set_a_band(spark):
    rng = random.Random(1)
    texts = [" ".join(f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{rng.choice(['', 's', 'n'])}" for _ in range(80)) for _ in range(120)]
    one = [(i, t) for i, t in enumerate(texts)]
    many = one + [(1000 + i, texts[0]) for i in range(500)]
    bands = [
        sorted(map(repr, fertility_bands(measure_fertility(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()))
        for rows in (one, many)
    ]
    assert bands[0] and bands[0] == bands[1]


def test_fertility_of_tables_without_language_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert judge_fertility(none).count() == 0
    rows = spark.createDataFrame([(None, None, "b"), (1, LONG, None)], "doc_id bigint, text string, band string")
    assert {(r.doc_id, r.kept, r.lang) for r in judge_fertility(rows).collect()} == {(None, False, ""), (1, False, "")}


def test_labelled_documents(spark):
    """Held-out labels: hardly any good document is rejected, most junk that passes the base rule is."""
    judged = judge_fertility(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    rows = judged.filter("NOT base_failed").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    good, junk = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.995 * len(good) and sum(junk) <= 0.45 * len(junk)
