"""Operators on texts against their definitions, and on untidy tables."""

import hashlib
import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from context_shaper.llm import secrets_scan
from context_shaper.llm.decontaminate import Winnowing, contamination, decontaminate
from context_shaper.llm.line_dedup import LineDedup, line_dedup
from context_shaper.llm.ngram_join import NgramJoin, _met_across, _pairs_across, ngram_join, one_of_each_group
from context_shaper.llm.personal import KINDS, Bootstrap, find_personal
from context_shaper.llm.secrets_scan import RULES, Rule, scan_versions
from context_shaper.session import stage
from tests.llm import plain

# Columns that share names with what the operators use inside.
UNTIDY = "doc_id bigint, text string, source string, version int, place string, h1 string, row string, drops int, Key string"
EXTRA = ("s", None, None, None, "r", 1, None)
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 4000


def untidy(spark, *texts):
    rows = [(i, t, *EXTRA) for i, t in texts]
    return spark.createDataFrame(rows, UNTIDY)


ROWS = [
    (1, None), (2, ""), (3, " \t \n "), (None, "no id but some words in a row here"), (4, LONG), (5, LONG), (6, "tie of words"),
    (6, "tie of words"), (7, "tie of words"), (8, "x" * 50_000), (9, "!!! ??? ..."), (10, "é😀 ñ" * 3),
]


def by_id(frame, *columns):
    return sorted(((r.doc_id, *[r[c] for c in columns]) for r in frame.collect()), key=repr)


def edited(words, rng, number):
    words = list(words)
    for _ in range(number):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(5)
    texts, number = {}, 0
    for size in (3, 12, 60, 200):
        for _ in range(4):
            base = [f"v{rng.randrange(500)}" for _ in range(size)]
            for edit in (0, 0, 1, 1, 2, 4):
                texts[number] = edited(base, rng, edit if size > 12 else min(edit, 1))
                number += 1
    return texts


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_ngram_join_finds_all_links(spark, near_texts, words, percent):
    docs = spark.createDataFrame(list(near_texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs, NgramJoin(words, percent)).collect()}
    assert got == plain.near_components(near_texts, words, percent)


def test_ngram_join_of_a_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"v{rng.randrange(5000)}" for _ in range(150)]
    texts = {i: edited(base, rng, i % 3) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs).collect()}
    assert got == plain.near_components(texts, 3, 90)


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_pairs_across_are_those_that_may_agree(spark, percent):
    rng = random.Random(percent)
    rows = [(rng.randrange(4), (i, i), rng.choice([rng.randrange(1, 30), rng.randrange(1, 400)])) for i in range(300)]
    rows = [(e, i, n, rng.randrange(n - -(-n * percent // 100) + 1)) for e, i, n in rows]
    kind = "element bigint, id struct<doc_id:bigint,h1:bigint>, n bigint, place int"
    shared = spark.createDataFrame(rows, kind)
    got = {(tuple(r.u), tuple(r.v)) for r in _pairs_across(shared, shared.select("id", F.col("id").alias("label")), percent).collect()}
    want = set()
    for (e, i, n, p), (f, j, m, q) in itertools.combinations(rows, 2):
        needed = -(-(n + m) * percent // (100 + percent))
        if e == f and 100 * n >= percent * m and 100 * m >= percent * n and min(n - p, m - q) >= needed:
            want.add((min(i, j), max(i, j)))
    assert got == want and (want or percent == 100)


def test_texts_of_a_template_list_no_pairs(spark):
    common = " ".join(f"c{i}" for i in range(20))
    texts = {i: f"{common} own{i} more{i}" for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert all(r.component_id == r.doc_id and r.n_shingles == 20 for r in ngram_join(docs).collect())
    # Two own shingles come first, so the first common one is at the third place.
    rows = spark.range(400).selectExpr("1L AS element", "struct(id AS doc_id, id AS h1) AS id", "20L AS n", "2 AS place")
    assert _met_across(rows.withColumn("label", F.col("id")), 90).count() == 0


def test_ngram_join_on_untidy_rows(spark):
    got = by_id(ngram_join(untidy(spark, *ROWS)), "n_shingles", "component_id")
    sizes = {i: len(plain.shingles(t, 3)) for i, t in ROWS}
    expected = {1: 1, 2: 2, 3: 3, None: None, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10}
    assert got == sorted(((i, sizes[i], expected[i]) for i, _ in ROWS), key=repr)
    assert sorted(r.doc_id for r in one_of_each_group(untidy(spark, *ROWS)).collect() if r.doc_id) == [
        1, 2, 3, 4, 6, 6, 8, 9, 10
    ]
    assert ngram_join(untidy(spark, *ROWS).limit(0)).count() == 0


def test_rows_that_share_a_doc_id_are_linked(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (5, "a b c d"), (5, "p q r s"), (9, "p q r s")], "doc_id bigint, text string")
    assert {r.component_id for r in ngram_join(docs).collect()} == {1}


def test_line_dedup_drops_what_the_definition_drops(spark):
    rng = random.Random(7)
    bases = [[f"v{rng.randrange(60)}" for _ in range(n)] for n in (3, 5, 9, 10, 11, 12, 30) for _ in range(3)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = list(rng.choice(bases))
            change = rng.randrange(5)
            at = rng.randrange(len(words))
            if change == 1:
                words[at] = "new"
            elif change == 2:
                del words[at]
            elif change == 3:
                words.insert(at, "put")
            lines.append(("  " if change == 4 else " ").join(words).upper() if change == 4 else " ".join(words))
        rows.append((i, "\n".join(lines)))
    got = by_id(line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)), "text")
    assert [t for _, t in got] == [t for _, t in sorted(zip(range(40), plain.kept_lines(rows)), key=repr)]


def test_line_dedup_on_untidy_rows(spark):
    docs = untidy(spark, *ROWS)
    done = line_dedup(docs)
    assert done.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = by_id(done, "text", "n_dropped", "row", "drops", "Key")
    texts = {i: (t, n) for i, t, n, *_ in got}
    assert texts[1] == (None, 0) and texts[2] == ("", 0) and texts[4] == (LONG, 0) and texts[5] == ("", 1)
    assert [g for g in got if g[0] == 6] == [(6, "tie of words", 0, "r", 1, None)] * 2
    assert line_dedup(docs.limit(0)).count() == 0
    exact = line_dedup(spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")], "doc_id int, text string"),
                       LineDedup(max_edits=0))
    assert exact.agg({"n_dropped": "sum"}).first()[0] == 0


BENCHMARK = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short ITEM here"), (3, None), (4, "..."),
    (None, "alpha beta gamma"), (12, "one two three four five six seven eight nine ten"), (5, "a a a a a a a a a a a a"),
    (6, "solo"),
]
LEAKS = [
    (1, "x one two three four five six seven eight nine ten eleven y"), (2, "one two three four five six seven eight nine"),
    (3, "a short item, here. Short-item/here"), (4, "alpha beta gamma"), (5, "a " * 30), (6, "ONE two, three four five six "
     "seven eight nine ten eleven twelve! solo"), (7, None), (8, ""), (9, "nothing"), (9, "nothing"), (None, "solo solo"),
]


@pytest.mark.parametrize("options", [Winnowing(), Winnowing(span=8, gram=4)])
def test_contamination_is_what_the_definition_says(spark, options):
    docs, items = untidy(spark, *LEAKS), spark.createDataFrame(BENCHMARK, "item_id bigint, text string")
    got = by_id(contamination(docs, items, options), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = []
    for i, text in LEAKS:
        count, found = plain.hits(text, [b for b in BENCHMARK if b[1]], options.span)
        ids = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        expected.append((i, len(plain.plain_words(text)), count, len(ids), digest, count > 0))
    assert got == sorted(expected, key=repr)
    clean = decontaminate(docs, items, options)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *rest in expected if not rest[-1])


def test_contamination_without_rows(spark):
    docs, items = untidy(spark, *LEAKS), spark.createDataFrame(BENCHMARK, "item_id bigint, text string")
    assert contamination(docs.limit(0), items).count() == 0
    assert not [r for r in contamination(docs, items.limit(0)).collect() if r.contaminated]
    assert contamination(untidy(spark, *ROWS), items).count() == len(ROWS)


def test_contamination_uses_built_in_functions_only(spark):
    docs, items = untidy(spark, *LEAKS), spark.createDataFrame(BENCHMARK, "item_id bigint, text string")
    for frame in (contamination(docs, items), find_personal(docs), scan_versions(docs)[0]):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


FOUND = [
    (1, "mail a.b+c@x-y.example.com, a@b.c_d@e.fg and 10.0.0.255 or 10.0.0.256 1.2.3.4.5.6.7.8 😀 +1 (555) 123-4567"),
    (2, "4111 1111 1111 1111, 4111-1111-1111-1112 and 5500005555555559 12 34 +12((((((((9 +1 2"), (3, None), (4, ""),
    (5, "@" * 50 + "a" * 20_000 + " 1" * 9000), (6, "é 000.00.0.0255 😀😀 x@y.z"), (6, "é 000.00.0.0255 😀😀 x@y.z"), (None, "a@b.co"),
    (7, "x@y..z 1.1.1 +1.2.3.4.5.6.7.8.9.0"),
]
HIDDEN = [
    (1, """token = "abcdef1" Password: secret=tok api_key:'A/b+c=' APIKEY = "x" """), (2, "AKIA" + "A1" * 8 + " AKIAAKIA AKIA" + "0" * 30),
    (3, None), (4, ""), (5, "0123456789abcdef01234567 " + "f" * 23 + " " + "e" * 5000), (6, """secret = "token": "abcdefgh" """),
    (7, "é😀 token=" + "Z" * 6), (7, "é😀 token=" + "Z" * 6), (None, "passwd = 'longenough'"), (8, "a" * 30_000 + " token" * 2000),
]


def test_personal_data_spans(spark):
    got = by_id(find_personal(untidy(spark, *FOUND)), *KINDS, "context")
    expected = [(i, *[v for v in plain.matches(t, plain.PERSONAL).values()], []) for i, t in FOUND]
    assert [(i, *[[tuple(s) for s in k] for k in rest]) for i, *rest in got] == sorted(
        expected, key=lambda r: repr((r[0], *[[f"Row(start={a}, end={b})" for a, b in k] for k in r[1:]]))
    ) or sorted([(i, *[[tuple(s) for s in k] for k in rest]) for i, *rest in got], key=repr) == sorted(expected, key=repr)
    assert find_personal(untidy(spark, *FOUND).limit(0)).count() == 0
    assert find_personal(untidy(spark, *ROWS)).count() == len(ROWS)


def test_bootstrap_discovers_identifiers_in_accepted_contexts(spark):
    rows = [(i, f"please write to u{i}@mail.example now") for i in range(8)]
    rows += [(20, "please write to user-77! now"), (21, "then we saw user-77 again"), (22, "room number 101 is free")]
    got = {r.doc_id: [tuple(s) for s in r.context] for r in find_personal(
        spark.createDataFrame(rows, "doc_id bigint, text string"), Bootstrap(support=5, confidence=0.6)).collect()}
    assert got[20] == [(16, 23)] and got[21] == [(12, 19)] and got[22] == [] and got[0] == []


def test_bootstrap_learns_from_and_finds_identifiers_of_several_tokens(spark):
    rows = [(i, f"so call me at +1 (555) 010-{1000 + i} today") for i in range(8)]
    rows += [(10 + i, f"or write to {c}@mail.example now") for i, c in enumerate("abcdefgh")]
    hidden = {20: ("so call me at ", "0171 2345 67", ", please"), 21: ("or write to ", "jane.doe(at)host.example", " now"),
              22: ("or write to ", "jane (at) host.example", " now"), 23: ("someone saw ", "0171 2345 67", " on paper")}
    rows += [(i, "".join(parts)) for i, parts in hidden.items()] + [(30, "in room 12 14 there is well-known 0171 art")]
    got = {r.doc_id: [tuple(s) for s in r.context] for r in find_personal(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, (before, value, _) in hidden.items():
        assert got[i] == [(len(before), len(before) + len(value))], i
    assert all(got[i] == [] for i in got if i not in hidden)


def test_bootstrap_goes_on_until_no_pattern_is_new(spark):
    # The instances of one pattern are known only when those of the one before have been learned.
    said = [[f"e{i}@mail.example" for i in range(6)], *[[f"id-{k}x{i}" for i in range(6)] for k in range(1, 6)]]
    rows = [f"see c{'abcde'[k]} is {x} now" for k in range(5) for x in said[k] + said[k + 1]]
    got = {r.doc_id for r in find_personal(
        spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), Bootstrap(confidence=0.5)).collect() if r.context}
    assert got == {i for i, t in enumerate(rows) if "@" not in t}


def test_secret_spans(spark):
    kinds = [rule.name for rule in RULES]
    found, added = scan_versions(untidy(spark, *HIDDEN))
    got = sorted([(r.doc_id, *[[tuple(s) for s in r[k]] for k in kinds]) for r in found.collect()], key=repr)
    assert got == sorted([(i, *plain.matches(t, plain.SECRETS).values()) for i, t in HIDDEN], key=repr)
    assert added.count() == len({t or "" for _, t in HIDDEN}) * len(RULES)
    assert scan_versions(untidy(spark, *HIDDEN).limit(0))[0].count() == 0
    assert scan_versions(untidy(spark, *ROWS))[0].count() == len(ROWS)


def test_increments_equal_one_scan(spark):
    texts = [t for _, t in HIDDEN] + ["token = abcdef%d" % (i % 7) for i in range(40)] + ["api_key: qwertz%04d" % i for i in range(30)]
    rows = [(i, t, "x", i, None) for i, t in enumerate(texts)]
    versions = spark.createDataFrame(rows, "doc_id bigint, text string, blob string, assign int, todo string")
    older = [Rule("assign", RULES[0].pattern, 2, 12, version=0), *RULES[1:]]
    want, scanned = scan_versions(versions)
    first, ledger = scan_versions(versions.filter("doc_id % 3 = 0"), rules=older)
    got, added = scan_versions(versions, ledger)
    kinds = [rule.name for rule in RULES]
    assert sorted((r.doc_id, *[r[k] for k in kinds]) for r in got.collect()) == sorted((r.doc_id, *[r[k] for k in kinds]) for r in want.collect())
    known = {r.blob for r in ledger.collect()}
    assert {(r.blob, r.rule) for r in added.collect()} == {
        (r.blob, r.rule) for r in scanned.collect() if r.blob not in known or r.rule == "assign"
    }
    assert added.count() == added.dropDuplicates(["blob", "rule"]).count()
    assert got.columns == ["doc_id", "blob", "todo", *kinds]
    assert scan_versions(versions, ledger.unionByName(added))[1].count() == 0


def shuffled_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {path: path.stat().st_size for folder in folders for path in Path(str(folder)).rglob("shuffle_*.data")}


def test_increments_shuffle_no_texts_that_occur_once(spark):
    rng = random.Random(11)
    rows = [(i, f"token = abcd{i:04d}\u00e9 " + rng.randbytes(2000).hex()) for i in range(1500)]
    rows += [(2000 + i, "a text of several copies, secret = abcdefgh") for i in range(40)]
    versions = stage(spark.createDataFrame(rows, "doc_id bigint, text string"), "versions")
    before = [Rule("assign", RULES[0].pattern, 2, 12, version=0), *RULES[1:]]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = shuffled_files(spark)
        _, ledger = scan_versions(versions.filter("doc_id % 2 = 0"), rules=before)
        found, added = scan_versions(versions, ledger)
        got = {r.doc_id: len(r.assign) for r in found.collect()}
        written = sum(size for path, size in shuffled_files(spark).items() if path not in old)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {i: 1 for i, _ in rows}
    assert added.count() == 1501 + 2 * 750
    assert 0 < written < 0.3 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("block, places", [(1, 1), (4, 8), (1 << 15, 1 << 15)])
def test_blobs_that_share_a_place_are_told_apart(spark, monkeypatch, block, places):
    monkeypatch.setattr(secrets_scan, "_BLOCK", block)
    monkeypatch.setattr(secrets_scan, "_PLACES", (places, places))
    texts = [t for _, t in HIDDEN] + ["token = abcdef%02d" % (i % 23) for i in range(40)]
    versions = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assign, access, hexes = RULES
    # The ledger lacks no rule, each of the rules, two of them or all: more lists than two bits tell.
    ledger = None
    for part, rules in enumerate(([access], [access, hexes], [hexes], list(RULES), [assign])):
        added = scan_versions(versions.filter(F.col("doc_id") % 6 == part), ledger, rules)[1]
        ledger = added if ledger is None else ledger.unionByName(added)
    found, added = scan_versions(versions, ledger)
    kinds = [rule.name for rule in RULES]
    assert sorted(((r.doc_id, *[[tuple(s) for s in r[k]] for k in kinds]) for r in found.collect())) == [
        (i, *plain.matches(t, plain.SECRETS).values()) for i, t in enumerate(texts)
    ]
    known = {(r.blob, r.rule) for r in ledger.collect()}
    every = {(hashlib.sha256((t or "").encode()).hexdigest(), k) for t in texts for k in kinds}
    assert sorted((r.blob, r.rule) for r in added.collect()) == sorted(every - known)


def test_the_ledger_spares_what_was_scanned(spark):
    first = untidy(spark, (1, "token = abcdef1"), (2, "nothing"))
    _, ledger = scan_versions(first)
    later = untidy(spark, (1, "token = abcdef1"), (3, "token = abcdef1"), (4, "token = another1"))
    found, added = scan_versions(later, ledger)
    assert {r.blob for r in added.collect()} == {hashlib.sha256(b"token = another1").hexdigest()}
    assert sorted((r.doc_id, len(r.assign)) for r in found.collect()) == [(1, 1), (3, 1), (4, 1)]
    newer = [Rule("assign", RULES[0].pattern, 2, 8, version=2), *RULES[1:]]
    found, added = scan_versions(later, ledger.unionByName(added), newer)
    assert {(r.rule, r.rule_version) for r in added.collect()} == {("assign", 2)}
    assert sorted((r.doc_id, len(r.assign)) for r in found.collect()) == [(1, 0), (3, 0), (4, 1)]
