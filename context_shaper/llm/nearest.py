"""Approximate nearest neighbours by cosine, with multiprobe p-stable hashing.

Method: each of several tables hashes a unit vector by floors of random Gaussian projections.  A
query looks into its own bucket and into perturbed buckets, in the order of their estimated success:
the expected squared distance to the bucket, from the ranks of the distances to the bucket's walls.
The candidates of all tables are merged and ranked by exact cosine in double precision.

Hashes, cell width, tables and probes come from the data: a sample of queries is compared with all
vectors, the distances to their true neighbours set the width, and of the settings whose probes meet
the wanted share of these neighbours the cheapest one is taken.  A comparison is paid for each vector
in a probed bucket, so more vectors ask for more hashes.

Equal vectors are one class of which the smallest ids are kept: more cannot be among the nearest.
Buckets are spread over parts of bounded size (large ones over several), and queries stream past the
vectors of a part, so no task holds more than one part's vectors.  Queries whose probed buckets hold
too few candidates are compared with all vectors of their length, part by part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from context_shaper.session import stage


@dataclass(frozen=True)
class Multiprobe:
    """``success`` is the share of sampled true neighbours that the probes must meet.  It is measured
    with ``sample_queries`` queries against all vectors, and the share of vectors in probed buckets
    with ``sample_rows`` vectors, for each of the ``lengths`` commonest lengths of vectors."""

    neighbours: int = 5
    success: float = 0.97
    sample_queries: int = 128
    sample_rows: int = 2048
    lengths: int = 8
    max_tables: int = 4
    max_probes: int = 1024
    part_rows: int = 4096
    seed: int = 3


@dataclass(frozen=True)
class Setting:
    """What is fitted to the vectors of one length, with the share of them that a query is compared
    with and the share of true neighbours found, as measured on the samples."""

    hashes: int
    width: float
    tables: int
    probes: int
    share: float
    recall: float


# Costs in comparisons of two vectors: a probe, and a vector that is sent to one more table.
PROBE_COST, TABLE_COST = 50, 100


def probe_order(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of walls to cross, as ranks by distance, in the order of their expected cost."""
    k = hashes
    cost = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    for j in range(k + 1, 2 * k + 1):
        rest = 2 * k + 1 - j
        cost.append(1 - rest / (k + 1) + rest * (rest + 1) / (4 * (k + 1) * (k + 2)))
    found, heap = [()], [(cost[0], (0,))]
    while heap and len(found) < probes:
        total, walls = heapq.heappop(heap)
        # The walls of ranks j and 2k-1-j are the two sides of one coordinate.
        if not any(2 * k - 1 - wall in walls for wall in walls):
            found.append(walls)
        last = walls[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total + cost[last + 1], (*walls, last + 1)))
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*walls[:-1], last + 1)))
    return found


def _values(matrix: np.ndarray, table: int, setting: Setting, seed: int) -> np.ndarray:
    """Projections of unit vectors in units of the cell width, shifted by a part of a cell."""
    random = np.random.default_rng((seed, table, matrix.shape[1], setting.hashes))
    lines = random.standard_normal((matrix.shape[1], setting.hashes)) / np.sqrt(matrix.shape[1])
    return matrix @ lines / setting.width + random.random(setting.hashes)


def _units(vectors: pa.Array) -> list[np.ndarray]:
    rows = [np.asarray(v, dtype=np.float64) for v in vectors.to_pylist()]
    return [row / np.linalg.norm(row) for row in rows]


def _keys(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cells."""
    key = np.full(len(cells), 0x243F6A8885A308D3, np.uint64)
    for column in cells.T:
        key = (key ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _buckets(matrix: np.ndarray, table: int, setting: Setting, seed: int, walls: list[tuple[int, ...]]) -> np.ndarray:
    """For each unit vector, the buckets reached by crossing each of the sets of walls."""
    value = _values(matrix, table, setting, seed)
    cells = np.floor(value).astype(np.int64)
    inside = value - cells
    order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1, kind="stable")
    cells = np.repeat(cells[:, None, :], len(walls), axis=1)
    rows = np.arange(len(matrix))
    for number, crossed in enumerate(walls):
        for wall in crossed:
            side = order[:, wall]
            cells[rows, number, side % setting.hashes] += np.where(side < setting.hashes, -1, 1)
    keys = _keys(cells.reshape(-1, setting.hashes) ^ (table * 1_000_003 + matrix.shape[1]))
    return keys.reshape(len(matrix), len(walls))


def _first_probe(probed: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """For each bucket, the number of the probe that meets it; beyond the last one if none does."""
    order = np.argsort(probed, kind="stable")
    at = np.minimum(np.searchsorted(probed[order], buckets), len(probed) - 1)
    return np.where(probed[order][at] == buckets, order[at], len(probed))


def choose_setting(
    queries: np.ndarray, neighbours: list[np.ndarray], sample: np.ndarray, rows: int, asked: int, options: Multiprobe
) -> Setting | None:
    """The cheapest setting for ``rows`` vectors and ``asked`` queries that meets the wanted share of
    the sampled queries' true neighbours.  All vectors are unit vectors.  None: no setting does."""
    pairs = np.concatenate([np.full(len(near), i) for i, near in enumerate(neighbours)]).astype(np.int64)
    near = np.concatenate(neighbours)
    distance = float(np.quantile(np.linalg.norm(queries[pairs] - near, axis=1), 0.8))
    spread = max(distance, 1e-3) / np.sqrt(queries.shape[1])
    bits, best, least = int(np.ceil(np.log2(rows + 1))), None, np.inf
    for hashes in range(4, max(bits, 4) + 3, max(2, bits // 6)):
        walls = probe_order(hashes, options.max_probes)
        for multiple in (1.5, 2.5, 4.0):
            draft = Setting(hashes, float(multiple * spread), 0, len(walls), 1.0, 0.0)
            hit = np.full(len(near), len(walls))
            met = np.full((len(queries), len(sample)), len(walls))
            for table in range(options.max_tables):
                probed = _buckets(queries, table, draft, options.seed, walls)
                targets = _buckets(near, table, draft, options.seed, [()])[:, 0]
                others = _buckets(sample, table, draft, options.seed, [()])[:, 0]
                for i, own in enumerate(probed):
                    mine = pairs == i
                    hit[mine] = np.minimum(hit[mine], _first_probe(own, targets[mine]))
                    met[i] = np.minimum(met[i], _first_probe(own, others))
                wanted = int(np.ceil(options.success * len(near))) - 1
                probes = int(np.partition(hit, wanted)[wanted]) + 1
                if probes > len(walls):
                    continue
                share = float((met < probes).mean())
                cost = share * rows + (table + 1) * (probes * PROBE_COST + TABLE_COST * rows / max(asked, 1))
                if cost < least:
                    least = cost
                    best = Setting(hashes, draft.width, table + 1, probes, share, float((hit < probes).mean()))
    return best


def _hash(settings: dict[int, Setting], seed: int, probing: bool):
    """(place, table, bucket) of every vector, and of every bucket that it probes."""
    walls = {length: probe_order(s.hashes, s.probes) if probing else [()] for length, s in settings.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                units = _units(batch.column(1))
                tables, buckets = [[] for _ in units], [[] for _ in units]
                for length in {len(unit) for unit in units} & set(settings):
                    chosen = [i for i, unit in enumerate(units) if len(unit) == length]
                    matrix = np.stack([units[i] for i in chosen])
                    for table in range(settings[length].tables):
                        keys = _buckets(matrix, table, settings[length], seed, walls[length])
                        for at, i in enumerate(chosen):
                            tables[i] += [table] * keys.shape[1]
                            buckets[i] += keys[at].tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(tables, pa.list_(pa.int32())), pa.array(buckets, pa.list_(pa.int64()))],
                    names=["class_id", "vector", "tables", "buckets"],
                )

    return run


def _compare_sample(queries, keep: int):
    """The best ``keep`` vectors of a task for each of the broadcast (class_id, unit vector)s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = queries.value
        best = np.full((len(own), keep), -np.inf)
        names = np.full((len(own), keep), -1, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                ids = np.asarray(batch.column(0).to_pylist(), np.int64)
                score = asked @ np.stack(_units(batch.column(1))).T
                score[own[:, None] == ids[None, :]] = -np.inf
                score = np.concatenate([best, score], axis=1)
                ids = np.concatenate([names, np.broadcast_to(ids, (len(own), len(ids)))], axis=1)
                top = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                best, names = np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1)
        there = np.isfinite(best)
        query = np.broadcast_to(own[:, None], names.shape)[there]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(names[there], pa.int64()), pa.array(best[there], pa.float64())],
            names=["query", "class_id", "score"],
        )

    return run


def _fit(classes: DataFrame, asked: DataFrame, options: Multiprobe) -> dict[int, Setting]:
    """A setting for each of the commonest lengths of the vectors in classes(class_id, vector)."""
    spark, settings = classes.sparkSession, {}
    asked = asked.select("class_id").distinct()
    lengths = classes.join(asked, "class_id").groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("asked"))
    for length, count in lengths.orderBy(F.desc("asked"), "length").limit(options.lengths).collect():
        alike = classes.filter(F.size("vector") == length).select("class_id", "vector")
        # Bounded samples, drawn by hash: at most sample_queries and sample_rows vectors.
        drawn = F.xxhash64("class_id", F.lit(options.seed))
        queries = alike.join(asked, "class_id").orderBy(drawn, "class_id").limit(options.sample_queries).toArrow()
        sample = alike.orderBy(drawn, "class_id").limit(options.sample_rows).toArrow()
        ids, matrix = np.asarray(queries["class_id"].to_pylist(), np.int64), np.stack(_units(queries["vector"]))
        sent = spark.sparkContext.broadcast((ids, matrix))
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "class_id")
        near = (
            alike.mapInArrow(_compare_sample(sent, options.neighbours), "query bigint, class_id bigint, score double")
            .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= options.neighbours).select("query", "class_id")
        )
        near = near.join(alike, "class_id").select("query", "vector").toArrow()  # sample_queries * neighbours rows at most
        if not near.num_rows:
            continue
        owner, vectors = np.asarray(near["query"].to_pylist(), np.int64), np.stack(_units(near["vector"]))
        chosen = choose_setting(
            matrix, [vectors[owner == i] for i in ids], np.stack(_units(sample["vector"])), alike.count(), count, options
        )
        if chosen:
            settings[length] = chosen
    return settings


def _search(options: Multiprobe):
    """Rows come sorted by (part, block, is_query): a part's vectors, then the queries that probe it."""
    keep = options.neighbours + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, buckets, ready = None, [], [], [], None
        for batch in batches:
            out = ([], [], [])
            for row in batch.to_pylist():
                if (row["part"], row["block"]) != at:
                    at, ids, vectors, buckets, ready = (row["part"], row["block"]), [], [], [], None
                if not row["is_query"]:
                    ids.append(row["class_id"])
                    vectors.append(row["vector"])
                    buckets.append(row["probed"][0])
                    continue
                if not ids:
                    continue
                if ready is None:
                    ready = _arranged(ids, vectors, buckets)
                query = np.asarray(row["vector"], dtype=np.float64)
                found, score = _best(query, np.asarray(row["probed"], np.int64), ready, keep)
                out[0].extend([row["class_id"]] * len(found))
                out[1].extend(found)
                out[2].extend(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                names=["query", "class_id", "score"],
            )

    return run


def _arranged(ids, vectors, buckets):
    ids, buckets = np.asarray(ids, np.int64), np.asarray(buckets, np.int64)
    order = np.argsort(buckets, kind="stable")
    matrix = [np.asarray(vectors[i], dtype=np.float64) for i in order]
    width = max(len(v) for v in matrix)
    full = np.zeros((len(matrix), width))
    for i, v in enumerate(matrix):
        full[i, : len(v)] = v
    return ids[order], buckets[order], full, np.array([np.linalg.norm(v) for v in matrix])


def _best(query: np.ndarray, probed: np.ndarray, ready, keep: int):
    """The best candidates of the probed buckets; sums run in one order, so scores always agree."""
    ids, buckets, full, norms = ready
    first, last = np.searchsorted(buckets, probed, "left"), np.searchsorted(buckets, probed, "right")
    rows = np.concatenate([np.arange(a, b) for a, b in zip(first, last) if b > a] or [np.zeros(0, np.int64)])
    if not len(rows):
        return [], []
    score = (full[rows, : len(query)] * query).sum(axis=1) / (norms[rows] * np.linalg.norm(query))
    if len(rows) > 4 * keep:
        least = np.partition(score, len(score) - keep)[len(score) - keep]
        rows, score = rows[score >= least], score[score >= least]
    order = np.lexsort((ids[rows], -score))[:keep]
    return ids[rows[order]].tolist(), score[order].tolist()


def _compared_with_all(classes: DataFrame, short: DataFrame, parts: int, options: Multiprobe) -> DataFrame:
    """(query, class_id, score): the best of all classes of the same length, for each of short(class_id)."""
    # The length stands for the bucket: every vector of a part is a candidate of the queries of its length.
    shown = classes.select("class_id", "vector", F.array(F.size("vector").cast("bigint")).alias("probed"))
    part, block = F.pmod(F.xxhash64("class_id"), F.lit(parts)), F.lit(0).alias("block")
    stored = shown.select(part.alias("part"), block, F.lit(False).alias("is_query"), "class_id", "vector", "probed")
    asking = shown.join(short, "class_id").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), block,
        F.lit(True).alias("is_query"), "class_id", "vector", "probed",
    )
    together = stored.unionByName(asking).repartition("part", "block").sortWithinPartitions("part", "block", "is_query")
    return together.mapInArrow(_search(options), "query bigint, class_id bigint, score double")


def _classes(vectors: DataFrame, queries: DataFrame, options: Multiprobe) -> tuple[DataFrame, DataFrame]:
    """(class_id, ids, vector) of the distinct vectors, and (vec_id, class_id) of the queries."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(
        F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0)
    ).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector")).distinct()
    keep = options.neighbours + 1
    first = Window.partitionBy("vector").orderBy("vec_id")
    members = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= keep)
    classes = stage(
        members.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .select(F.get("ids", F.lit(0)).alias("class_id"), "ids", "vector"), "vector-classes",
    )
    asked = stage(
        rows.join(queries.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct(), "vec_id")
        .join(classes.select("vector", "class_id"), "vector").select("vec_id", "class_id"), "asked",
    )
    return classes, asked


def fitted_settings(vectors: DataFrame, queries: DataFrame, options: Multiprobe = Multiprobe()) -> dict[int, Setting]:
    """The settings, with their measured recall and candidate share, by length of vector."""
    return _fit(*_classes(vectors, queries, options), options)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, options: Multiprobe = Multiprobe()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries(vec_id), the nearest other rows of
    vectors(vec_id, embedding, ...), nearest first and ties to the smaller vec_id.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do
    rows without vec_id; vectors are compared with those of the same length, and those of rare
    lengths (see Multiprobe) and very long ones like any others.  Rows that repeat both vec_id and vector count once.  Queries that name no such vector have no rows; one has fewer rows than
    neighbours only where fewer vectors are left.  Other columns are
    ignored; an empty table gives an empty result.
    """
    classes, asked = _classes(vectors, queries, options)
    settings = _fit(classes, asked, options)
    keep = options.neighbours + 1
    kind = classes.schema["vector"].dataType.simpleString()
    hashed = f"class_id bigint, vector {kind}, tables array<int>, buckets array<bigint>"
    pair = F.explode(F.arrays_zip("tables", "buckets")).alias("p")
    parts = classes.count() // options.part_rows + 1
    indexed = stage(
        classes.select("class_id", "vector").mapInArrow(_hash(settings, options.seed, False), hashed).select("class_id", "vector", pair)
        .select("class_id", "vector", F.col("p.tables").alias("table"), F.col("p.buckets").alias("bucket")), "index",
    )
    # A bucket beyond a part's size is dealt over several blocks.
    large = indexed.groupBy("table", "bucket").agg(F.count("*").alias("n")).filter(
        F.col("n") > options.part_rows
    ).select("table", "bucket", F.ceil(F.col("n") / options.part_rows).cast("int").alias("blocks"))
    large = stage(large, "large-buckets")
    part = (F.col("table") * parts + F.pmod(F.col("bucket"), F.lit(parts))).alias("part")
    block = F.when(F.col("blocks").isNotNull(), 1 + F.pmod(F.xxhash64("class_id"), F.col("blocks").cast("bigint"))).otherwise(F.lit(0))
    stored = indexed.join(large, ["table", "bucket"], "left").select(
        part, block.cast("int").alias("block"), F.lit(False).alias("is_query"), "class_id", "vector",
        F.array("bucket").alias("probed"),
    )
    wanted = classes.join(asked.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "vector")
    probing = wanted.mapInArrow(_hash(settings, options.seed, True), hashed).select("class_id", "vector", pair).select(
        "class_id", F.col("p.tables").alias("table"), F.col("p.buckets").alias("bucket")
    ).distinct()
    blocks = F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(1), F.col("blocks"))).otherwise(F.array(F.lit(0)))
    probes = probing.join(large, ["table", "bucket"], "left").select(
        "class_id", part, F.explode(blocks).alias("block"), "bucket"
    ).groupBy("class_id", "part", "block").agg(F.array_sort(F.collect_set("bucket")).alias("probed"))
    asking = probes.join(wanted, "class_id").select(
        "part", "block", F.lit(True).alias("is_query"), "class_id", "vector", "probed"
    )
    together = stored.unionByName(asking).repartition("part", "block").sortWithinPartitions("part", "block", "is_query")
    found = together.mapInArrow(_search(options), "query bigint, class_id bigint, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "class_id")

    def nearest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("query", "class_id").agg(F.max("score").alias("score")).withColumn(
            "r", F.row_number().over(best)
        ).filter(F.col("r") <= keep).drop("r")

    found = stage(nearest(found), "found")
    members = found.join(classes.select("class_id", F.size("ids").alias("n")), "class_id").groupBy("query").agg(F.sum("n").alias("n"))
    enough = members.filter(F.col("n") >= keep).select(F.col("query").alias("class_id"))
    short = stage(asked.select("class_id").distinct().join(enough, "class_id", "left_anti"), "short")
    if not short.isEmpty():
        found = found.join(enough.withColumnRenamed("class_id", "query"), "query", "left_semi").unionByName(
            nearest(_compared_with_all(classes, short, parts, options))
        )
    others = found.join(classes.select("class_id", "ids"), "class_id").select(
        F.col("query").alias("asked_class"), "score", F.explode("ids").alias("vec_id")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        asked.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("asked_class")).join(others, "asked_class")
        .filter("query_id <> vec_id").withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= options.neighbours).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
