"""Mixing, quality, archives, URLs, neighbours and the pipeline."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from context_shaper.llm.mixing import Curriculum, _inverse_demand, mix_documents, mix_plan
from context_shaper.llm.nearest import Multiprobe, choose_setting, fitted_settings, nearest_neighbours, probe_order
from context_shaper.llm.quality import keep_good, kth_largest, resample
from context_shaper.llm.url_filter import Mining, fixed_rules, host_and_path, judge_urls, mine_rules
from context_shaper.llm.warc import Bundles, parse_record, read_archives, seek_table, write_archives
from pyspark.sql import functions as F
from tests.llm import plain
from tests.llm.test_text_operators import ROWS, untidy

SF = "/root/testdata/sf0.001"


def mixed_rows():
    rng = random.Random(3)
    rows = []
    for source, count, top in (("a", 120, 30), ("b", 15, 30), ("c", 3, 10), (None, 10, 20), ("d", 0, 0), ("é", 5, 5)):
        rows += [(len(rows) + i, "w " * rng.randrange(1, top), source) for i in range(count)]
    return rows + [(1000, None, "a"), (1001, "", "empty"), (5, rows[5][1], "a"), (5, rows[5][1], "a"), (None, "x y", "b")]


def test_mix_meets_its_targets(spark):
    rows = mixed_rows()
    plan = mix_plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(plan) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(plain.spaced_words(text))
    targets = plain.targets(sizes)
    for source, size in sizes.items():
        own = [r for r in plan if r.source == source]
        assert {r.source_size for r in own} == {size} and own[0].target == pytest.approx(targets[source])
        assert sum(r.size for r in own) == size
        taken = sum(r.taken for r in own)
        assert targets[source] - max(r.size for r in own) <= taken <= targets[source] + 1e-6
        for r in own:
            assert r.taken <= 3 * r.size and len(r.positions) * r.size == r.taken or r.size == 0 and r.positions == []
            assert all(0 <= p <= 1 for p in r.positions)


def test_reruns_and_partitions_do_not_change_the_mix(spark):
    docs = spark.createDataFrame(mixed_rows(), "doc_id bigint, text string, source string")
    first, again = mix_plan(docs), mix_plan(docs.repartition(9))
    assert sorted(map(repr, first.collect())) == sorted(map(repr, again.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_short_documents_fill_what_a_long_one_leaves(spark, seed):
    rows = [(0, "w " * 20_000, "a")] + [(1 + i, "w " * 50, "a") for i in range(400)]
    rows += [(500 + i, "w " * 1000, "b") for i in range(60)]
    rows += [(1000, "w " * 70, "c")] * 30 + [(1001, "w " * 9000, "c"), (1002, "w " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = mix_plan(docs, Curriculum(weights=(1.0, 2.0, 0.3, 0.1), seed=seed)).collect()
    for source in ("a", "b", "c", None):
        own = [r for r in plan if r.source == source]
        taken, size, target = sum(r.taken for r in own), own[0].source_size, own[0].target
        # What was taken as often as whole passes go can be taken once more.
        left = [r.size for r in own if r.taken <= target // size * r.size]
        assert taken <= target + 1e-6 and (not left or target >= 3 * size or target - taken < min(left)), source


def test_positions_follow_the_schedules(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate("abc" * 400)]
    plan = mix_plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), Curriculum(weights=(1.0,))).collect()
    middle = {s: np.mean([p for r in plan if r.source == s for p in r.positions]) for s in "abc"}
    assert middle["a"] < 0.47 < middle["b"] < 0.53 < middle["c"]


@pytest.mark.parametrize("knots", [((0.0, 2.0), (0.5, 0.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 3.0)), ((0.0, 1.0), (0.2, 4.0), (1.0, 0.5))])
def test_inverse_demand(spark, knots):
    times = np.linspace(0, 1, 100_001)
    weight = np.interp(times, *zip(*knots))
    total = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    shares = [0.0, 0.1, 0.37, 0.5, 0.9, 0.999]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(_inverse_demand(F.col("s"), knots)).collect()]
    assert got == pytest.approx([times[np.searchsorted(total, s * total[-1])] for s in shares], abs=1e-3)


def test_mix_on_untidy_rows(spark):
    docs = untidy(spark, *ROWS)
    assert mix_plan(docs).count() == len(ROWS)
    mixed = mix_documents(docs)
    assert mixed.columns == [*docs.columns, "position"] and mixed.count() > 0
    positions = [r.position for r in mixed.collect()]
    assert positions == sorted(positions)
    assert mix_plan(docs.limit(0)).count() == mix_documents(docs.limit(0)).count() == 0


def quality_tables(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = [f"word{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(20, 80))]
        bad = i % 6 == 0
        if bad:
            words = [w if rng.random() < 0.8 else rng.choice(["vile", "nasty", "***"]) for w in words]
        rows.append((i, " ".join(words)))
        if i % 3 != 1:
            labels.append((i, 1, 0) if not bad else (i, 0, 0) if i % 12 == 0 else (i, 1, 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_resampling_keeps_good_and_rejects_bad(spark):
    docs, labels = quality_tables(spark)
    got = resample(docs, labels).collect()
    assert len(got) == 900
    kept = {r.doc_id for r in got if r.kept}
    good, bad = [i for i in range(900) if i % 6], [i for i in range(0, 900, 6)]
    assert len(kept & set(good)) / len(good) > 0.97 and len(kept & set(bad)) / len(bad) < 0.05
    again = {r.doc_id for r in resample(docs.repartition(5), labels).collect() if r.kept}
    assert again == kept
    drawn = sum(r.log_weight >= 0 for r in got)
    assert len(kept) == drawn and min(r.score for r in got if r.kept) > max(r.score for r in got if not r.kept)


def test_resampling_on_untidy_rows(spark):
    docs, labels = quality_tables(spark)
    both = docs.unionByName(untidy(spark, *[(i and i + 5000, t) for i, t in ROWS]).select("doc_id", "text"))
    odd = spark.createDataFrame([(None, 1, 0), (5006, None, None), (0, 1, 1), (0, 1, 1)], labels.schema)
    got = {r.doc_id: r for r in resample(both, labels.union(odd)).collect()}
    assert all(not got[5000 + i].kept and got[5000 + i].log_weight is None for i in (1, 2, 3))
    untidy_docs = untidy(spark, *ROWS)
    assert keep_good(untidy_docs, labels.limit(0)).columns == untidy_docs.columns
    assert sorted(r.doc_id or 0 for r in keep_good(untidy_docs, labels.limit(0)).collect()) == [0, 4, 5, 6, 6, 7, 8, 9, 10]
    assert resample(untidy_docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 300 + [1e9, -1e9, None]
    scores = spark.createDataFrame([(v,) for v in values], "score double")
    ranked = sorted((v for v in values if v is not None), reverse=True)
    for k in (1, 2, 150, 300, 500, 802, 10**6):
        assert kth_largest(scores, k, cells=16) == ranked[min(k, len(ranked)) - 1]
    assert kth_largest(scores, 0) is None and kth_largest(scores.limit(0), 3) is None


LARGE = "<p>" + "é" * 700 + "</p>"
PAGES = [
    (1, "http://a/1", LARGE, "x"), (2, "http://a/2", LARGE, None), (9, "http://b/ \r\nEvil: 1", LARGE, "y"), (3, None, "small", "y"),
    (4, "http://a/4", "small", "y"), (5, "http://a/5", None, None), (6, "http://a/6", "", "z"), (9, "http://b/again", LARGE, "y"),
    (None, "http://n", LARGE, "n"), (7, "http://a/7", "Q" * 300_000, "q"), (8, "http://a/8", "Q" * 300_000, "q"),
]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, digest string").repartition(2)
    options = Bundles(frame_bytes=2000, bundle_bytes=5000)
    folder = f"file://{tmp_path}/warc"
    index = write_archives(pages, folder, options)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(index, folder).collect()), key=repr)
    expected = []
    for page_id, _, html, _ in PAGES:
        payload = (html or "").encode()
        holder = max((p for p, _, h, _ in PAGES if h == html and p), default=None) if len(payload) >= 1000 else page_id
        again = page_id != holder
        expected.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", holder if again else None))
    assert got == sorted(expected, key=repr)
    one = read_archives(index.filter("page_id = 7"), folder).collect()
    assert [bytes(r.payload) for r in one if r.payload] in ([], [b"Q" * 300_000])
    bundles = list((tmp_path / "warc").iterdir())
    assert len(bundles) == len({r.bundle for r in index.collect()}) > 1
    for bundle in bundles:
        content = bundle.read_bytes()
        frames = seek_table(content)
        rows = [r for r in index.collect() if r.bundle == bundle.name]
        offsets = np.concatenate([[0], np.cumsum([packed for packed, _ in frames])])
        assert all(r.frame_offset == offsets[r.frame] and r.frame_bytes == frames[r.frame][0] for r in rows)
        assert len(content) == offsets[-1] + 8 + 8 * len(frames) + 9
    assert write_archives(pages.limit(0), folder, options).count() == 0


def test_a_header_cannot_be_smuggled_in(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, digest string")
    folder = f"file://{tmp_path}/warc"
    urls = {r.url for r in read_archives(write_archives(pages, folder), folder).collect()}
    assert "http://b/%20%0D%0AEvil:%201" in urls and None in urls
    with pytest.raises(ValueError):
        seek_table(b"0" * 20)
    assert parse_record(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:>\r\nContent-Length: 20\r\n\r\nHTTP/1.1 200 OK\r\n\r\nab")["payload"] == b"a"


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URLS = [
    ("https://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://x.net/", "x.net", "/", "net/", "block"),
    ("http://x.net", "x.net", "", None, "allow"), ("http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
    ("ftp://m.example.com/de/?q#f", "m.example.com", "/de/", "example.com/de/", "block"), (None, "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://?a=b", "", "", None, "allow"),
    ("http://o.org/fr/a://b", "o.org", "/fr/a://b", "org/fr/", "allow"), ("http://o.org/FR/", "o.org", "/FR/", None, "allow"),
    ("http://" + "h" * 30_000 + "/" + "p" * 30_000, "h" * 30_000, "/" + "p" * 30_000, None, "allow"),
]


def test_url_rules(spark):
    rows = [(i, u[0], "x") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "x"), (None, URLS[0][0], None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = judge_urls(pages, fixed_rules(spark, RULES), none)
    expected = [(i, *u[1:]) for i, u in enumerate(URLS)] + [(0, *URLS[0][1:]), (None, *URLS[0][1:])]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert judge_urls(pages.limit(0), fixed_rules(spark, RULES), none).count() == 0


def test_mined_rules_block_what_the_labels_show(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        url = f"http://{'casino' if bad else 'site'}-{i % 7}.example.com/{'win' if bad else 'news'}/{i}?ref={i}"
        rows.append((i, url))
        if rng.random() < 0.6:
            labels.append((url, bad))
    labels += [(None, True), ("http://unlabelled.example.com/", None)]
    got = judge_urls(
        spark.createDataFrame(rows, "page_id bigint, url string"), fixed_rules(spark, RULES),
        spark.createDataFrame(labels, "url string, bad boolean"), Mining(support=0.02, confidence=0.8),
    )
    assert {r.page_id for r in got.collect() if r.verdict == "block"} == set(range(0, 300, 5))


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(None, True), ([], True), (["a", "b"], None)]
    for _ in range(400):
        tokens = [t for t in "abcdefgh" if rng.random() < 0.35] + ["all"]
        tokens += ["twin", "twin2"] if "c" in tokens else []
        sure = {"a", "b"} <= set(tokens) or "h" in tokens and "d" in tokens
        rows.append((tokens, rng.random() < (0.95 if sure else 0.1)))
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    for least, confidence in ((8, 0.7), (3, 0.3)):
        got = mine_rules(labelled, Mining(support=0.0, least=least, confidence=confidence)).collect()
        want = plain.mined_rules(rows, least, confidence, 1.645)
        assert {tuple(r["all"]): (r.bad, r.covered) for r in got} == want and len(got) == len(want)
        assert all(r.key in r["all"] for r in got)
    assert {("a", "b"), ("d", "h")} <= set(plain.mined_rules(rows, 8, 0.7, 1.645))


def test_rules_hold_on_urls_not_mined(spark):
    rng = random.Random(10)
    pages, labels, truth = [], [], {}
    for i in range(1200):
        kind = rng.choice(["bets", "pills", "news", "blog", "docs", "shop"])
        deep = ".".join(rng.choice("abc") for _ in range(8))
        path = rng.choice(["win", "free", "about", "list"])
        url = f"http://{deep}.{kind}-{rng.randrange(40)}.example.com/{path}/{i}?ref={i}"
        truth[i] = (kind == "bets" or kind == "shop" and path == "free") ^ (rng.random() < 0.03)
        pages.append((i, url))
        if i % 2:
            labels.append((url, truth[i]))
    judged = judge_urls(
        spark.createDataFrame(pages, "page_id bigint, url string"), fixed_rules(spark, []), spark.createDataFrame(labels, "url string, bad boolean")
    ).filter("page_id % 2 = 0 AND verdict = 'block'")
    blocked = {r.page_id for r in judged.collect()}
    bad = {i for i, b in truth.items() if b and i % 2 == 0}
    assert len(blocked & bad) >= 0.9 * len(blocked) and len(blocked & bad) >= 0.85 * len(bad)


def test_labels_without_signal_give_no_rules(spark):
    rng = random.Random(11)
    rows = [([rng.choice("abcdef"), rng.choice("uvwxyz"), f"r{i}"], rng.random() < 0.25) for i in range(2000)]
    assert mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).count() == 0


def test_equally_long_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.bc/de/")], "page_id bigint, url string")
    rules = fixed_rules(spark, [("block", "bc/de/"), ("allow", "bc/de/"), ("allow", "a.bc/d")])
    none = spark.createDataFrame([], "url string, bad boolean")
    assert [r.rule for r in judge_urls(pages, rules.filter("rule <> 'bc/de/' OR verdict = 'block'"), none).collect()] == ["a.bc/d"]


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((10, 32))
    points = centres[rng.integers(0, 10, 1500)] + 0.8 * rng.standard_normal((1500, 32))
    points[700:760] = points[700]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, [None] + [1.0] * 31), (5200, []), (None, [1.0] * 32), (50, rows[50][1])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest_neighbours(vectors, vectors.filter("vec_id % 50 = 0"), Multiprobe(part_rows=200)).collect()
    units = points / np.linalg.norm(points, axis=1)[:, None]
    hit, total = 0, 0
    for query in range(0, 1500, 50):
        own = sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        score = units @ units[query]
        score[query] = -2
        assert [(r.score, -r.vec_id) for r in own] == sorted([(r.score, -r.vec_id) for r in own], reverse=True)
        assert all(r.score == pytest.approx(score[r.vec_id], abs=1e-12) for r in own)
        best = np.lexsort((np.arange(1500), -np.round(score, 12)))[:5]
        hit, total = hit + len(set(best) & {r.vec_id for r in own}), total + 5
    assert hit / total >= 0.9
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 700), key=lambda r: r.rank)] == [701, 702, 703, 704, 705]
    assert {r.query_id for r in got} == set(range(0, 1500, 50))
    assert nearest_neighbours(vectors.limit(0), vectors).count() == 0


def test_few_candidates_are_all_returned(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [1.0, 0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = nearest_neighbours(vectors, vectors.filter("vec_id = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)]


def test_a_query_far_from_all_gets_its_neighbours(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    points = centre + 0.02 * rng.standard_normal((300, 64))
    points[0] = -points[0] + 0.05 * rng.standard_normal(64)
    few = rng.standard_normal((6, 48))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate([*points, *few])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest_neighbours(vectors, vectors.filter("vec_id = 0 OR vec_id >= 300"), Multiprobe(part_rows=100)).collect()
    for query, group, first in ((0, points, 0), *[(300 + i, few, 300) for i in range(6)]):
        units = group / np.linalg.norm(group, axis=1)[:, None]
        score = units @ units[query - first]
        score[query - first] = -2
        own = sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)
        assert [r.vec_id - first for r in own] == np.argsort(-score)[:5].tolist()


def test_recall_does_not_depend_on_the_dimension(spark):
    points = np.random.default_rng(4).standard_normal((1200, 16))
    units = points / np.linalg.norm(points, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    hit = 0
    got = nearest_neighbours(vectors, vectors.filter("vec_id % 30 = 0")).collect()
    for query in range(0, 1200, 30):
        score = units @ units[query]
        score[query] = -2
        hit += len(set(np.argsort(-score)[:5]) & {r.vec_id for r in got if r.query_id == query})
    assert hit / 200 >= 0.9


def test_larger_inputs_are_compared_with_a_smaller_share():
    rng, chosen = np.random.default_rng(7), []
    for n in (2_000, 16_000, 128_000):
        centres = rng.standard_normal((n // 20, 32))
        points = centres[rng.integers(0, n // 20, n)] + 0.25 * rng.standard_normal((n, 32))
        units = points / np.linalg.norm(points, axis=1)[:, None]
        near = [units[np.argsort(-(units @ units[i]))[1:6]] for i in range(100)]
        sample = units[rng.choice(n, 2000, replace=False)]
        chosen.append(choose_setting(units[:100], near, sample, n, n // 50, Multiprobe()))
    assert all(setting.recall >= 0.97 for setting in chosen)
    assert chosen[0].share > chosen[1].share > chosen[2].share and chosen[2].share < 0.05
    assert chosen[0].hashes <= chosen[1].hashes < chosen[2].hashes


def test_clashing_columns_and_lengths_without_a_setting(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(8 if i < 60 else 6)], i, "x", -1.0) for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, class_id int, table string, score double")
    asked, options = vectors.filter("vec_id % 30 = 0"), Multiprobe(lengths=1)
    assert list(fitted_settings(vectors, asked, options)) == [8]
    got = nearest_neighbours(vectors, asked, options).collect()
    units = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows}
    score = {i: float(units[60] @ units[i]) for i in range(61, 90)}
    assert [r.vec_id for r in sorted(got) if r.query_id == 60] == sorted(score, key=lambda i: -score[i])[:5]
    assert got[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"} and len(got) == 15


def test_probes_come_in_order_of_cost():
    order = probe_order(4, 40)
    assert order[0] == () and order[1] == (0,) and len(set(order)) == 40
    assert all(not {w, 7 - w} <= set(walls) for walls in order for w in walls)


def test_pipeline_stages_on_untidy_rows(spark):
    docs = untidy(spark, *ROWS)
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, SF).columns == docs.columns, name
        assert function(spark, docs.limit(0), SF).count() == 0, name


def test_pipeline_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for _, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SF), "step")
        counts.append((docs.count(), docs.select("doc_id").distinct().count()))
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    mixed = docs.collect()
    assert counts[0][0] < 200 and counts[1][0] == counts[0][0] and counts[3][0] < counts[2][0]
    assert not [r for r in mixed if plain.hits(r.text, benchmark)[0]]
    once = {r.doc_id: r.text for r in mixed}
    groups = plain.near_components(once, 5, 80)
    assert all(groups[i][1] == i for i, t in once.items() if plain.spaced_words(t))
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)


def test_repeated_rows_are_mixed_as_often_as_planned(spark):
    rows = [(1, "a b c", "s")] * 4 + [(2, "d e f g", "s"), (3, "h", "t"), (3, "h", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    planned = {}
    for r in mix_plan(docs).collect():
        planned[(r.doc_id, r.source)] = planned.get((r.doc_id, r.source), 0) + len(r.positions)
    mixed = {}
    for r in mix_documents(docs).collect():
        mixed[(r.doc_id, r.source)] = mixed.get((r.doc_id, r.source), 0) + 1
    assert mixed == {key: count for key, count in planned.items() if count}
