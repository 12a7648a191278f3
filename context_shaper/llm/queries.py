"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from context_shaper.llm.bit_planes import resample_to_target
from context_shaper.llm.conversation_repair import audit_conversations
from context_shaper.llm.decontaminate import contamination
from context_shaper.llm.fertility import judge_fertility
from context_shaper.llm.line_dedup import line_dedup
from context_shaper.llm.mixing import mix_plan
from context_shaper.llm.nearest import nearest_neighbours
from context_shaper.llm.ngram_join import ngram_join
from context_shaper.llm.personal import KINDS, find_personal
from context_shaper.llm.quality import resample
from context_shaper.llm.secrets_scan import RULES, Rule, scan_versions
from context_shaper.llm.url_filter import fixed_rules, judge_urls
from context_shaper.llm.warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLES["op1_line_dedup"] = r"""
WITH texts AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(range(0, len(parts))) AS line, unnest(parts) AS said FROM texts
), worded AS (
    SELECT doc_id, line, regexp_extract_all(
        translate(said, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM lines
), long_enough AS (
    SELECT w, len(w) AS n, min((doc_id, line)) AS first FROM worded WHERE len(w) >= 5 GROUP BY w
), sized AS (
    SELECT *, unnest([n, n - 1]) AS shorter FROM long_enough WHERE n >= 10
), halves AS (
    SELECT w, n, first, shorter, 1 AS side, w[1:shorter // 2] AS half FROM sized
    UNION ALL
    SELECT w, n, first, shorter, 2, w[n - (shorter - shorter // 2) + 1:n] FROM sized
), near AS (
    SELECT DISTINCT a.w, a.first FROM halves a JOIN halves b
    ON a.shorter = b.shorter AND a.side = b.side AND a.half = b.half AND b.first < a.first AND a.w <> b.w
    WHERE CASE
        WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> b.w[i])) <= 1
        WHEN a.n = b.n + 1 THEN len(list_filter(range(1, a.n + 1), lambda i: a.w[1:i - 1] = b.w[1:i - 1] AND a.w[i + 1:a.n] = b.w[i:b.n])) > 0
        ELSE len(list_filter(range(1, b.n + 1), lambda i: b.w[1:i - 1] = a.w[1:i - 1] AND b.w[i + 1:b.n] = a.w[i:a.n])) > 0 END
), dropped AS (
    SELECT x.doc_id, x.line FROM worded x JOIN long_enough l ON x.w = l.w
    WHERE (x.doc_id, x.line) <> l.first OR l.first IN (SELECT first FROM near)
), gone AS (
    SELECT doc_id, list(line) AS numbers FROM dropped GROUP BY doc_id
)
SELECT t.doc_id, array_to_string(list_filter(t.parts, lambda x, i: NOT list_contains(coalesce(g.numbers, []), i - 1)), chr(10)) AS text,
    len(t.parts) AS n_lines, coalesce(len(g.numbers), 0) AS n_dropped
FROM texts t LEFT JOIN gone g USING (doc_id)
"""


ORACLES["op6_ngram_join"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), elements AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets
), met AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS nu, any_value(b.n) AS nv
    FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id
        AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT u, v FROM met WHERE 100 * c >= 90 * (nu + nv - c)
), both_ways AS (
    SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON r.other = b.u
)
SELECT d.doc_id, coalesce(len(s.s), 0) AS n_shingles, m.component_id
FROM documents d JOIN sets s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("version")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("version")


ORACLES["op2_decontamination"] = r"""
WITH items AS (
    SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size,
        unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS span
    FROM items WHERE len(w) > 0
), texts AS (
    SELECT doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
    FROM documents
), sizes AS (
    SELECT DISTINCT size FROM windows
), spans AS (
    SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS first,
        unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS span
    FROM texts, sizes WHERE len(w) >= size
), found AS (
    SELECT s.doc_id, s.first, s.size, x.item_id FROM spans s JOIN windows x USING (size, span)
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
        SELECT doc_id, unnest(range(first, first + size)) AS place FROM (SELECT DISTINCT doc_id, first, size FROM found))
    GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT t.doc_id, len(t.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
    sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit h USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"))


def _labels(found: str) -> Column:
    return F.transform(found, lambda s: F.concat_ws(":", F.lit(found), s["start"], s["end"]))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [rule.name for rule in RULES]
    documents = table(spark, sf_dir, "documents")
    # Two increments: half of the sources came earlier, when the first rule was another one.
    earlier = documents.filter(F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 2 == 0).select("doc_id", "text")
    before = [Rule(RULES[0].name, RULES[0].pattern, RULES[0].group, 2 * RULES[0].least, version=0), *RULES[1:]]
    _, ledger = scan_versions(earlier, rules=before)
    found, _ = scan_versions(documents.select("doc_id", "text"), ledger)
    order = F.array_sort(F.flatten(F.array(*[
        F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end")))
        for i, kind in enumerate(kinds)
    ])))
    names = F.array(*[F.lit(kind) for kind in kinds])
    listed = F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in kinds], listed.alias("spans")
    ).select("doc_id", *[f"n_{kind}" for kind in kinds], F.sha2("spans", 256).alias("base_sha256"), "spans")


ASSIGNED = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ORACLES["op9_secrets"] = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), found AS (
    SELECT doc_id, 0 AS rank, 'assign' AS kind, string_split_regex(t, '{ASSIGNED}') AS parts, regexp_extract_all(t, '{ASSIGNED}') AS ms FROM d
    UNION ALL
    SELECT doc_id, 1, 'access', string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
    UNION ALL
    SELECT doc_id, 2, 'hex', string_split_regex(t, '[0-9a-f]{{24,}}'), regexp_extract_all(t, '[0-9a-f]{{24,}}') FROM d
), each_match AS (
    SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found WHERE len(ms) > 0
), placed AS (
    SELECT doc_id, rank, kind, ms[i] AS m, (list_sum(list_transform(parts[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS first FROM each_match
), kept AS (
    SELECT *, first + length(m) AS after FROM placed WHERE CASE kind
        WHEN 'assign' THEN length(regexp_extract(m, '{ASSIGNED}', 2)) >= 6 WHEN 'access' THEN length(m) >= 20 ELSE true END
), listed AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || first || ':' || after, ',' ORDER BY first, rank) AS spans
    FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    base = F.flatten(F.array(*[_labels(kind) for kind in KINDS]))
    return found.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _labels("context")), ",").alias("spans"),
    )


_PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_TOKEN = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _matches(rank: int, kind: str, pattern: str) -> str:
    return (
        f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, string_split_regex(t, '{pattern}') AS parts, "
        f"regexp_extract_all(t, '{pattern}') AS ms FROM d"
    )


_ROUND = """
scored{n} AS (
    SELECT pattern FROM edges GROUP BY pattern
    HAVING count(*) FILTER (core IN (SELECT core FROM learned{m})) >= 5
        AND count(*) FILTER (core IN (SELECT core FROM learned{m})) >= count(*) * 0.6
), learned{n} AS (
    SELECT core FROM edges WHERE pattern IN (SELECT pattern FROM scored{n}) UNION SELECT core FROM learned0
)"""

ORACLES["op10_personal_data"] = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), found AS (
    {" UNION ALL ".join(_matches(i, kind, pattern) for i, (kind, pattern) in enumerate(_PERSONAL))}
    UNION ALL {_matches(9, "token", _TOKEN)}
), each_match AS (
    SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found WHERE len(ms) > 0
), placed AS (
    SELECT doc_id, rank, kind, ms[i] AS m, parts[i] AS before, regexp_replace(ms[i], '[^0-9]', '', 'g') AS n,
        (list_sum(list_transform(parts[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS first FROM each_match
), kept AS (
    SELECT doc_id, rank, kind, first, first + length(m) AS after FROM placed WHERE CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN regexp_full_match(m, '{_PART}(\.{_PART}){{3}}')
        WHEN 'card' THEN length(n) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(n) + 1),
            lambda i: CASE WHEN i % 2 = 1 THEN substr(n, length(n) - i + 1, 1)::INT
                ELSE 2 * substr(n, length(n) - i + 1, 1)::INT - 9 * (substr(n, length(n) - i + 1, 1)::INT > 4)::INT END)) % 10 = 0
        WHEN 'phone' THEN length(n) BETWEEN 9 AND 15 ELSE false END
), stripped AS (
    SELECT doc_id, first + length(regexp_extract(m, '^([^A-Za-z0-9+]*)', 1)) AS first,
        regexp_replace(substr(m, length(regexp_extract(m, '^([^A-Za-z0-9+]*)', 1)) + 1), '[^A-Za-z0-9]*$', '') AS core,
        string_split(rtrim(translate(before, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
            'abcdefghijklmnopqrstuvwxyz     ')), ' ') AS said
    FROM placed WHERE kind = 'token'
), tokens AS (
    SELECT doc_id, first, first + length(core) AS after, core, array_to_string(said[greatest(len(said) - 1, 1):len(said)], ' ') AS pattern
    FROM stripped
), marked AS (
    SELECT t.*, coalesce(bool_or(k.first >= t.first AND k.after <= t.after), false) AS known,
        coalesce(bool_or(k.first < t.after AND t.first < k.after), false) AS taken
    FROM tokens t LEFT JOIN kept k USING (doc_id) WHERE pattern <> '' AND core <> '' GROUP BY ALL
), candidates AS (
    SELECT * FROM marked WHERE known OR NOT taken
), edges AS (
    SELECT pattern, core, bool_or(known) AS known FROM candidates GROUP BY ALL
), learned0 AS (
    SELECT DISTINCT core FROM edges WHERE known
), {_ROUND.format(n=1, m=0)}, {_ROUND.format(n=2, m=1)}, spans AS (
    SELECT * FROM kept UNION ALL
    SELECT DISTINCT doc_id, 4, 'context', first, after FROM candidates
    WHERE NOT known AND (pattern IN (SELECT pattern FROM scored2) OR core IN (SELECT core FROM learned2))
), listed AS (
    SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip,
        count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
        string_agg(kind || ':' || first || ':' || after, ',' ORDER BY rank, first) FILTER (rank < 4) AS base,
        string_agg(kind || ':' || first || ':' || after, ',' ORDER BY rank, first) AS spans
    FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op3_warc"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), h AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM h
"""


# The rules of the URL contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # A page shows the document whose number its path ends with; that document's labels are the page's.
    shown = pages.select("url", F.regexp_extract("url", r"/([0-9]{1,18})(?:[/.?#]|$)", 1).alias("n")).distinct()
    bad = labels.select(F.col("doc_id").cast("string").alias("n"), ((F.col("quality") < 1) | (F.col("toxic") > 0)).alias("bad"))
    labelled = shown.join(bad, "n").select("url", "bad")
    return judge_urls(pages, fixed_rules(spark, URL_RULES), labelled)


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 50 = 0"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample_to_target(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _half_byte_steps() -> str:
    """What four shifts of the CRC-32 register add, for each value of the bits shifted out."""
    steps = list(range(16))
    for _ in range(4):
        steps = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in steps]
    return ", ".join(str(x) for x in steps)


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of a text: its bytes' hexadecimal digits one by one, the lower of a byte first."""
    digits = (
        f"list_transform(range(1, length(hex(encode({text}))) + 1), lambda i: "
        f"strpos('0123456789ABCDEF', substr(hex(encode({text})), (i + 2 * (i % 2) - 1)::BIGINT, 1)) - 1)"
    )
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), "
        f"lambda r, x: xor(r >> 4, [{_half_byte_steps()}][(xor(r, x) & 15) + 1])), 4294967295)"
    )


ORACLES["op12_importance_resampling"] = rf"""
WITH texts AS (
    SELECT 0 AS wanted, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), worded AS (
    SELECT wanted, row, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w
    FROM texts
), features AS (
    SELECT wanted, row, unnest(list_concat(
        w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')),
        list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS f
    FROM worded
), counted AS (
    SELECT wanted, row, f, count(*) AS n FROM features GROUP BY ALL
), hashed AS (
    SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted)
), held AS (
    SELECT wanted, row, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL
), totals AS (
    SELECT coalesce(sum(n) FILTER (wanted = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (wanted = 1), 0)::DOUBLE AS t FROM held
), gains AS (
    SELECT bucket, floor(1000 * ln((sum(n) FILTER (wanted = 1) + 1)::DOUBLE * (any_value(s) + 10000)
        / ((sum(n) FILTER (wanted = 0) + 1)::DOUBLE * (any_value(t) + 10000))))::BIGINT AS gain
    FROM (SELECT wanted, bucket, n FROM held UNION ALL SELECT x, bucket, 0 FROM hashed, (VALUES (0), (1)) v(x)), totals
    GROUP BY bucket
), weighed AS (
    SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN gains USING (bucket)
    WHERE wanted = 0 GROUP BY row
), scored AS (
    SELECT w.doc_id, len(w.w) >= 20 AS able, coalesce(x.n_features, 0) AS n_features, coalesce(x.weight, 0) AS weight,
        coalesce(x.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296)))::BIGINT AS score
    FROM worded w LEFT JOIN weighed x USING (row) WHERE w.wanted = 0
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= n_able * 5 // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n_able FROM scored)
"""


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_fertility(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, doubled or given to the user by a hash of conversation and turn."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    shown = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    rows = rows.withColumn("fault", F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    audits = audit_conversations(damaged(conversations))
    known = conversations.select(F.col("conv_id").alias("c")).distinct()
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.join(audits, known["c"].eqNullSafe(audits["conv_id"]), "left").select(
        F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _paid(path: str, cost: int | str, letter: str) -> str:
    return f"{{'c': {path}.c + {cost}, 's': {path}.s || '{letter}'}}"


def _least(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


_INSERTED = (
    f"p0, p1, {_least('p2', *[_paid(f'p{q}', 5, 'I') for q in (0, 1, 3)])} AS p2, {_least('p3', _paid('p2', 5, 'I'))} AS p3"
)
_KEPT = "CASE WHEN gone THEN 1000000000 ELSE extra END + CASE WHEN initial = '{}' THEN 0 ELSE 1000000000 END"
_REROLED = "CASE WHEN gone THEN 1000000000 ELSE extra + 1 END"
_TO_USER = [path for q in (0, 1, 3) for path in (_paid(f"p{q}", _KEPT.format("u"), "K"), _paid(f"p{q}", _REROLED, "R"))]
_EDITED = f"""{_paid('p0', 2, 'D')} AS p0, {_least(_paid('p1', 2, 'D'), _paid('p0', _KEPT.format('s'), 'K'))} AS p1,
            {_least(_paid('p2', 2, 'D'), *_TO_USER)} AS p2,
            {_least(_paid('p3', 2, 'D'), _paid('p2', _KEPT.format('a'), 'K'), _paid('p2', _REROLED, 'R'))} AS p3"""
_SPACE = r"[\x20\x09-\x0D]"

ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE hashed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
), faulty AS (
    SELECT *, {crc32_sql("place")} % 20 AS fault FROM hashed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(0, CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
    FROM faulty WHERE fault <> 0
), placed AS (
    SELECT conv_id, turn, role, text, left(role, 1) AS initial,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i
    FROM damaged
), judged AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        regexp_extract(text, '([^\x20\x09-\x0D]){_SPACE}*$', 1) AS ending,
        coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
    FROM placed
), marked AS (
    SELECT *, blank OR seen > 1 AS gone, NOT blank AND seen > 1 AS duplicate,
        NOT blank AND seen = 1 AND ending NOT IN ('.', '!', '?') AS truncated,
        CASE WHEN ending NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra
    FROM judged
), walked AS (
    SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 's': ''}} AS p0, {{'c': 1000000000::BIGINT, 's': ''}} AS p1,
        {{'c': 5::BIGINT, 's': 'I'}} AS p2, {{'c': 10::BIGINT, 's': 'II'}} AS p3
    FROM (SELECT DISTINCT conv_id FROM marked)
    UNION ALL
    SELECT conv_id, i, {_INSERTED} FROM (SELECT conv_id, i, {_INSERTED} FROM (
        SELECT w.conv_id, m.i, {_EDITED}
        FROM walked w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1))
), facts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (illegal) AS illegal
    FROM marked GROUP BY conv_id
), solved AS (
    SELECT f.*, {_least('w.p0', 'w.p3')} AS best FROM facts f JOIN walked w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n
), letters AS (
    SELECT conv_id, unnest(range(1, length(best.s) + 1)) AS k, unnest(string_split(best.s, '')) AS letter FROM solved WHERE best.s <> ''
), counted AS (
    SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY k) AS i,
        sum((letter <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY k) AS o FROM letters
), met AS (
    SELECT c.*, CASE WHEN c.letter <> 'I' THEN m.role END AS role, CASE WHEN c.letter = 'I' THEN '' ELSE m.text END AS text,
        max((c.o = 1 AND c.letter = 'K' AND m.initial = 's')::INT) OVER (PARTITION BY c.conv_id) AS opened
    FROM counted c LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.i = c.i
), repaired AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || text, chr(10) ORDER BY k) AS lines
    FROM met WHERE letter <> 'D' GROUP BY conv_id
)
SELECT d.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
    coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, coalesce(s.best.c, 0) AS cost,
    coalesce(s.best.s, '') AS audit, sha256(coalesce(r.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM d.conv_id
"""
